"""Byte-level BPE with word ends, encoded by prefix-sharing trie traversal.

The encoding of every prefix of a word is settled by one number, the last token of that prefix: the rest is the
encoding of the prefix that this token leaves. The last token is the one vocabulary entry at the prefix's end that
the last token before it tolerates, that is, no merge across the border of the two comes due while both of its
sides still stand. So the distinct words form a trie in which a node's state depends on the nodes above it alone,
and is computed once however many words go through it. The words are walked in sorted order, which is the depth-first
order of that trie: the stack of the path keeps the states that a word shares with the one before it. A word's last
character carries the word-end mark, so its end is a state of its own (a leaf).

Whether one token tolerates another is read off the merges: the right edge of the left token (itself, its right part,
that one's right part ...) and the left edge of the right one, each with the merge at which it is used up. A merge
of two such parts before either is used up joins the tokens; at equal merges the leftmost goes first.

Text is normalised and cut into words by the tokenizer file's own rules (the library's normaliser and pre-tokenizer,
run on the distinct stretches between blanks); added tokens are cut out first, as the library does.

Defined cases: null and empty texts have no ids and decode to the empty text; extra columns are not read; null and
repeated doc_ids give a row each; an empty table gives an empty result. Long words cost time in proportion to their
length. Files that are not such a BPE (parts made after use, two merges with one result, missing symbols,
byte fallback, unknown tokens, other decoders) are refused with ``ValueError``.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.llm.piecewise import chunks

#: White space that no word holds in any of the supported files; texts are cut there and nowhere else.
BLANKS = re.compile(r"[^ \t\n\r]+")
#: Characters of stretches that a worker remembers before it forgets them all (a cache: results don't depend on it).
MOST_CHARACTERS = 8_000_000
#: Pairs of tokens remembered before a new call of ``words`` forgets them.
MOST_PAIRS = 1 << 18
#: Stretches that go through the file's rules at once.
TOGETHER = 1000
_NEVER = 1 << 60


class Vocabulary:
    """The tables of a tokenizer file, and a walk over words that uses them."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer
        spec = json.loads(source)
        model = spec["model"]
        if (model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")
                or model.get("continuing_subword_prefix") or not model.get("end_of_word_suffix") or spec.get("decoder")):
            raise ValueError("not a BPE with word ends and without a decoder")
        # only the rules are wanted of the library: its own copy of the vocabulary would cost every worker tens of MB
        rules = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self.normalizer, self.pre_tokenizer = rules.normalizer, rules.pre_tokenizer
        self.end = model["end_of_word_suffix"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or not t["content"] or BLANKS.fullmatch(t["content"]) is None for t in spec["added_tokens"]):
            raise ValueError("added tokens that depend on their surroundings")
        self.added = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        ids = model["vocab"]
        self.names: list[str | None] = [None] * (1 + max([-1, *ids.values(), *added.values()]))
        for t, i in [*ids.items(), *added.items()]:
            self.names[i] = t
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._derive(ids, merges)

    def _derive(self, ids: dict[str, int], merges: list[tuple[str, str]]) -> None:
        made = {a + b for a, b in merges}
        #: vocabulary entries by their characters: within a word, and at its end
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        #: by id: characters, the merge that makes it (-1: a character, None: no entry), and that merge's parts
        self.width, self.birth, self.left, self.right = ([None] * len(self.names) for _ in range(4))
        self.pairs: dict[tuple[int, int], int] = {}
        for name, i in ids.items():
            if name not in made:
                at_end = len(name) > 1 and name.endswith(self.end)
                characters = name[:-len(self.end)] if at_end else name
                if len(characters) != 1:
                    raise ValueError(f"{name!r} is neither a character nor made by a merge")
                (self.final if at_end else self.inner)[characters] = i
                self.birth[i], self.width[i] = -1, 1
        if self.inner.keys() - self.final.keys():
            raise ValueError("a character without its word-end form")
        ends = set(self.final.values())
        for rank, (a, b) in enumerate(merges):
            x, y, i = ids.get(a), ids.get(b), ids.get(a + b)
            if None in (x, y, i) or self.birth[x] is None or self.birth[y] is None or self.birth[i] is not None or x in ends:
                raise ValueError(f"merge {rank} uses parts that are not there yet, or makes one again")
            self.pairs[x, y] = rank
            self.birth[i], self.left[i], self.right[i] = rank, x, y
            self.width[i] = self.width[x] + self.width[y]
            if y in ends:
                ends.add(i)
                self.final[(a + b)[:-len(self.end)]] = i
            else:
                self.inner[a + b] = i
        self.longest = max((w for w in self.width if w), default=1)
        #: pairs of tokens and whether the first tolerates the second, as far as asked
        self.seen: dict[tuple[int, int], bool] = {}

    def _tolerates(self, a: int, b: int) -> bool:
        """Whether the texts of ``a`` and ``b`` side by side are encoded as these two tokens.

        From the finished tokens back in time: ``until`` is the merge before which both parts stand."""
        until = _NEVER
        while True:
            if self.pairs.get((a, b), _NEVER) < until:
                return False
            x, y = self.birth[a], self.birth[b]
            if x < 0 and y < 0:
                return True
            if y >= x:
                until, b = y + 1, self.left[b]     # used up by its own merge, which comes after one to its left
            else:
                until, a = x, self.right[a]

    def words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct words, given in the characters of the vocabulary."""
        out = {}
        inner, final, width, longest = self.inner.get, self.final.get, self.width, self.longest
        if len(self.seen) > MOST_PAIRS:
            self.seen.clear()
        seen, known = self.seen, self.seen.get
        path: list[int] = []        # the last token of every prefix of the word before, from one character on
        add = path.append
        before = ""
        for word in sorted(words):
            n = len(word)
            shared = 0
            most = min(n - 1, len(path))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared:]
            entry = inner
            for end in range(shared + 1, n + 1):
                if end == n:
                    entry = final
                start = end - 1
                least = end - longest if end > longest else 0
                while True:
                    token = entry(word[start:end])
                    if token is not None:
                        if not start:
                            break
                        pair = path[start - 1], token
                        good = known(pair)
                        if good is None:
                            good = seen[pair] = self._tolerates(*pair)
                        if good:
                            break
                    start -= 1
                    if start < least:
                        raise ValueError(f"no token ends at character {end} of {word[:80]!r}")
                add(token)
            ids, at = [], n
            while at:
                token = path[at - 1]
                ids.append(token)
                at -= width[token]
            out[word] = tuple(reversed(ids))
            path.pop()              # the end of a word is no prefix of another
            before = word
        return out

    def cut(self, stretch: str) -> list[str]:
        """The words of a stretch of text without blanks, by the file's own rules."""
        text = self.normalizer.normalize_str(stretch) if self.normalizer else stretch
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def cuts(self, stretches: list[str]) -> list[list[str]]:
        """``cut`` of each: printable ones, which hold no white space, go through the rules with a blank between them."""
        plain = [k for k, s in enumerate(stretches) if s.isprintable()]
        out: list[list[str] | None] = [None] * len(stretches)
        for i in range(0, len(plain), TOGETHER):
            some = plain[i:i + TOGETHER]
            for k, words in zip(some, self._together([stretches[k] for k in some]) or ()):
                out[k] = words
        return [self.cut(s) if words is None else words for s, words in zip(stretches, out)]

    def _together(self, stretches: list[str]) -> list[list[str]] | None:
        """The words of each, or nothing if the rules change blanks or put one into a word."""
        text = " ".join(stretches)
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        if text.count(" ") != len(stretches) - 1:
            return None
        found = self.pre_tokenizer.pre_tokenize_str(text)
        ends = np.cumsum([len(s) + 1 for s in text.split(" ")])  # behind the blank after each
        at = np.array([x for _, x in found], np.int64).reshape(-1, 2)
        of = np.searchsorted(ends, at[:, 0], side="right")
        if len(at) and (at[:, 1] >= ends[of]).any():
            return None
        words = [w for w, _ in found]
        edges = np.searchsorted(of, np.arange(len(stretches) + 1)).tolist()
        return [words[a:b] for a, b in zip(edges, edges[1:])]


class Encoder(dict):
    """Encodes texts; remembers stretches (as numbers) and words within a task (results don't depend on that)."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.words: dict[str, tuple[int, ...]] = {}
        self.size = 0
        # the ids of the numbered stretches, laid end to end
        self.counts, self.starts, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def __missing__(self, stretch: str) -> int:
        n = self[stretch] = len(self)
        self.new.append(stretch)
        return n

    def _stretches(self, text: str) -> list[str]:
        if self.v.special is None or not self.v.special.search(text):
            return BLANKS.findall(text)
        out, at = [], 0
        for m in self.v.special.finditer(text):
            out += BLANKS.findall(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + BLANKS.findall(text[at:])

    def _learn(self) -> None:
        added = self.v.added
        cuts = self.v.cuts(self.new)
        words = {w for s, c in zip(self.new, cuts) if s not in added for w in c} - self.words.keys()
        self.words |= self.v.words(list(words))
        of = self.words.__getitem__
        ids = [(added[s],) if s in added else of(c[0]) if len(c) == 1 else tuple(chain.from_iterable(map(of, c))) for s, c in zip(self.new, cuts)]
        self.size += sum(map(len, self.new)) + sum(map(len, words))
        self.new = []
        self.counts = np.r_[self.counts, np.fromiter(map(len, ids), np.int64, len(ids))]
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(ids), np.int32)]
        self.starts = np.cumsum(self.counts) - self.counts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.size > MOST_CHARACTERS:
            self._forget()
        numbers = []
        for t in texts:
            parts = self._stretches(t) if t else []
            numbers.append(np.fromiter(map(self.__getitem__, parts), np.int64, len(parts)))
        if self.new:
            self._learn()
        out = []
        for k in numbers:
            n = self.counts[k]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.starts[k] - ends + n, n) + np.arange(int(ends[-1]) if len(k) else 0)])
        return out


@lru_cache(2)
def parsed(source: str) -> Vocabulary:
    return Vocabulary(source)


def load(path: str) -> str:
    """The tokenizer file's text, checked; workers parse it once each."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    parsed(source)
    return source


def _decoded(v: Vocabulary, ids: list[int]) -> str:
    names, n = v.names, len(v.names)
    return " ".join([names[i] for i in ids if 0 <= i < n and names[i] is not None])


def encode(docs: DataFrame, source: str, *, text: bool = False) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs``; with ``text`` also the ids decoded again, as ``decode`` does, in
    the same worker. The file (some MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches):
        enc = Encoder(parsed(shared.value))
        for batch in batches:
            done = 0
            for part in chunks(batch.column(1)):
                found = enc.encode(part)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int32), *found])
                out = {"doc_id": batch.column(0).slice(done, len(part)), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
                if text:
                    out["text"] = pa.array([_decoded(enc.v, f.tolist()) for f in found], pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
                done += len(part)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", text string" if text else ""))


def decode(tokens: DataFrame, source: str) -> DataFrame:
    """Adds ``text`` to the rows of ``tokens``: the tokens of ``ids`` with one space between them (no file of this kind has a
    decoder of its own); null ids give the empty text, unknown ids nothing."""
    shared = tokens.sparkSession.sparkContext.broadcast(source)
    kept = [c for c in tokens.columns if c != "text"]
    schema = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        v = parsed(shared.value)
        for batch in batches:
            texts = [_decoded(v, x.as_py() or []) for x in batch.column(batch.schema.get_field_index("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, "text"])
    return tokens.select(*kept).mapInArrow(run, f"{schema}, text string")


def digest(docs: DataFrame, source: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the digests of the ids and of the decoded text."""
    d = encode(docs, source, text=True)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                    F.sha2("text", 256).alias("decoded_sha256"))
