"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text is written with its spaces as U+2581, one put in front; since no piece has that sign after
another character, the words before each run of it are independent. The distinct new words of a batch
are laid out in one flat array of symbols. In every round each word merges its pair of the best rank, all
its leftmost occurrences at once, and the array is compacted; a word without a pair leaves. Where a merge
could make a pair of a better rank, or different pieces share a rank, an occurrence waits for those
shortly before it, which is the order in which the library works.

A long word is not one unit but stretches of twice the longest piece: a merge can only change what lies
within a piece's length of it, so a stretch merges its best pair as soon as neither neighbour has a better one, and
leaves when neither it nor its neighbours have a pair. A long word then takes no more rounds than its stretches need.
Only texts such as ``hahaha``, whose repeated pair must wait for the one before it, still take a round an occurrence.

Defined cases: null and empty texts have no ids and decode to the empty text. Characters without a
piece become byte pieces. Models that normalise text, strip white space, or hold user-defined or unused
pieces are refused with ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
_NONE = np.int64(1 << 40)
#: Bytes of text that are encoded together, and words that a worker remembers: some 90 MB in all, of two workers or more an executor.
CHUNK_BYTES, MOST_WORDS = 1 << 19, 300_000
#: A run of the space sign longer than this is cut into equal blocks first.
LONG_RUN = 128


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _message(b: bytes):
    """(field number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i:i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = b[i:i + n], i + n
        yield tag >> 3, value


#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Vocabulary:
    """The pieces of a model and the tables that encoding needs."""
    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    prefix: bool
    # derived tables
    letters: dict = field(default_factory=dict, repr=False)  # character -> symbol; numbers from len(pieces) on aren't pieces
    pair_keys: np.ndarray = field(default=None, repr=False)
    pair_merged: np.ndarray = field(default=None, repr=False)
    rank: np.ndarray = field(default=None, repr=False)
    alone: np.ndarray = field(default=None, repr=False)  # symbols whose merge must be the only one of its word in a round
    longest: int = 1  # code points of the longest piece
    touching: np.ndarray = field(default=None, repr=False)  # pairs of characters that stand side by side in some piece
    block: int = 0

    @staticmethod
    def read(model: bytes) -> "Vocabulary":
        pieces, kinds, scores, prefix, escape = [], [], [], True, 1
        for number, value in _message(model):
            if number == 1:
                f = dict(_message(value))
                pieces.append(f[1].decode())
                scores.append(struct.unpack("<f", f[2])[0])
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                if dict(_message(value)).get(3) != 2:
                    raise ValueError("not a BPE model")
            elif number == 3:
                f = dict(_message(value))
                prefix, escape = bool(f.get(3, 1)), f.get(5, 1)
                if f.get(2) or f.get(6) or f.get(4, 1):
                    raise ValueError("the model normalises text or strips white space")
        if not escape or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("the model has user-defined or unused pieces, or leaves spaces as they are")
        if kinds.count(BYTE) != 256:
            raise ValueError("the model has no byte pieces")
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, kinds) if k == NORMAL):
            raise ValueError("a piece has a space after another character")
        return Vocabulary(pieces, kinds, scores, prefix)._derive()

    def _derive(self) -> "Vocabulary":
        number = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in number.values()}, reverse=True))}
        symbols = dict(number)
        for p in number:
            for ch in p:
                symbols.setdefault(ch, len(self.pieces) + len(symbols))
        self.longest = max(map(len, number), default=1)
        size = max(symbols.values(), default=0) + 2
        self.rank = np.full(size, _NONE, np.int64)
        self.alone = np.zeros(size, bool)
        shared: dict[int, int] = {}
        for p, i in number.items():
            self.rank[i] = order[self.scores[i]]
            if len(p) > 1:
                shared[self.rank[i]] = shared.get(self.rank[i], 0) + 1
        rows = []
        for p, i in number.items():
            if len(p) > 1 and shared[self.rank[i]] > 1:
                self.alone[i] = True
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    rows.append((a, b, i))
                    for part, text in ((a, p[:cut]), (b, p[cut:])):
                        if len(text) > 1 and self.rank[part] >= self.rank[i]:
                            self.alone[part] = True
        table = np.array(sorted((a << 32 | b, i) for a, b, i in rows), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_merged = table[:, 0].copy(), table[:, 1].copy()
        self.letters = {p: i for p, i in symbols.items() if len(p) == 1}
        self.touching = np.array(sorted({symbols[a] << 32 | symbols[b] for p in number for a, b in zip(p, p[1:])}), np.int64)
        self.block = self._block()
        return self

    def _block(self) -> int:
        """Length of the piece that tiles a long run of spaces from the left (0 if none does)."""
        if SPACE not in self.letters or LONG_RUN < 64:
            return 0
        seen = [encode_words(self, [SPACE * n])[1] for n in (LONG_RUN, LONG_RUN + 7)]
        first = int(seen[0][0])
        n = len(self.pieces[first]) if first < len(self.pieces) else 1
        steady = (LONG_RUN - 60) // n
        return n if all((s[:steady] == first).all() for s in seen) and n > 1 else 0


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, all ids in order) of ``words``."""
    n = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    distinct, inverse = np.unique(points, return_inverse=True)
    unknown = len(v.rank) - 1  # a symbol that no pair has
    symbol = np.array([v.letters.get(chr(p), unknown) for p in distinct], np.int64)[inverse] if len(points) else points
    owner = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(points))  # where a symbol's first character stands
    # characters that no piece has side by side can never be joined: a word falls apart there
    if len(points):
        word = np.cumsum(np.r_[0, (owner[1:] != owner[:-1]) | ~_among(v.touching, symbol[:-1] << 32 | symbol[1:])])
    else:
        word = owner
    merged, rank = _pairs(v, symbol, word, np.arange(len(symbol)))
    done: list[tuple] = []
    stretch = 2 * v.longest
    while len(symbol):
        new_word = np.r_[True, word[1:] != word[:-1]]
        part = at // stretch
        starts = np.flatnonzero(new_word | np.r_[True, part[1:] != part[:-1]])
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(symbol)])
        # the best ranks of the stretches on both sides, in the same word
        opens = new_word[starts]
        before = np.where(opens, _NONE, np.r_[_NONE, best[:-1]])
        after = np.where(np.r_[opens[1:], True], _NONE, np.r_[best[1:], _NONE])
        over = (best == _NONE) & (before == _NONE) & (after == _NONE)
        leads = (best < _NONE) & (best <= before) & (best <= after)
        if over.any():
            # what lies on both sides of a stretch that leaves can no longer meet
            word = np.cumsum(new_word | np.repeat(over | np.r_[False, over[:-1]], sizes) & _heads(starts, len(symbol)))
            left = ~np.repeat(over, sizes)
            done.append((symbol[~left], at[~left]))
            symbol, word, at, merged, rank = symbol[left], word[left], at[left], merged[left], rank[left]
            best, leads, sizes = best[~over], leads[~over], sizes[~over]
            if not len(symbol):
                break
        of = np.repeat(np.arange(len(best)), sizes)
        hit = np.flatnonzero((rank == best[of]) & (rank < _NONE))
        # overlapping occurrences follow each other: every second one of a run counts, if the run's start may merge
        run = np.r_[True, (np.diff(hit) > 1) | (rank[hit][1:] != rank[hit][:-1])]
        start = np.flatnonzero(run)[np.cumsum(run) - 1]
        take = ((np.arange(len(hit)) - start) % 2 == 0) & leads[of[hit[start]]] & leads[of[hit]]
        # an occurrence that must not meet another's merge waits for those less than a piece before it
        apart = np.r_[True, (word[hit][1:] != word[hit][:-1]) | (np.diff(at[hit]) >= v.longest) | (rank[hit][1:] != rank[hit][:-1])]
        take &= apart | ~v.alone[merged[hit]]
        hit = hit[take]
        symbol[hit] = merged[hit]
        alive = np.ones(len(symbol), bool)
        alive[hit + 1] = False
        new = np.cumsum(alive) - 1
        changed = new[hit]
        symbol, word, at, merged, rank = symbol[alive], word[alive], at[alive], merged[alive], rank[alive]
        touched = np.zeros(len(symbol), bool)
        touched[changed] = True
        touched[changed[changed > 0] - 1] = True
        changed = np.flatnonzero(touched)
        merged[changed], rank[changed] = _pairs(v, symbol, word, changed)
    if not done:
        return np.zeros(len(words), np.int64), np.empty(0, np.int64)
    symbol, at = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(at)
    symbol, at = symbol[order], at[order]
    word = owner[at]
    strange = symbol >= len(v.pieces)
    if strange.any():
        byte = {v.pieces[i]: i for i in range(len(v.pieces)) if v.kinds[i] == BYTE}
        spelled = {p: [byte[f"<0x{x:02X}>"] for x in chr(p).encode("utf-8", "surrogatepass")] for p in np.unique(points[at[strange]]).tolist()}
        times = np.ones(len(symbol), np.int64)
        times[strange] = [len(spelled[p]) for p in points[at[strange]].tolist()]
        put = np.repeat(strange, times)
        symbol, word = np.repeat(symbol, times), np.repeat(word, times)
        symbol[put] = [x for p in points[at[strange]].tolist() for x in spelled[p]]
    return np.bincount(word, minlength=len(words)), symbol


def _heads(starts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[starts] = True
    return out


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _pairs(v: Vocabulary, symbol: np.ndarray, word: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(merged symbol, rank) of the pairs that begin at ``where``; no pair crosses a word's end."""
    merged = np.zeros(len(where), np.int64)
    rank = np.full(len(where), _NONE, np.int64)
    inside = np.flatnonzero(where + 1 < len(symbol))
    inside = inside[word[where[inside]] == word[where[inside] + 1]]
    if len(inside) and len(v.pair_keys):
        w = where[inside]
        key = symbol[w] << 32 | symbol[w + 1]
        spot = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        ok = v.pair_keys[spot] == key
        merged[inside[ok]] = v.pair_merged[spot[ok]]
        rank[inside[ok]] = v.rank[v.pair_merged[spot[ok]]]
    return merged, rank


class Encoder(dict):
    """Encodes texts; remembers words within a task (results don't depend on that)."""

    _split = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.new: list[str] = []
        self._forget()

    def _forget(self):
        self.clear()
        self.counts, self.starts, self.flat = (np.empty(0, np.int64) for _ in range(3))

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def words(self, text: str) -> list[str]:
        s = text.replace(" ", SPACE)
        return self._split.findall(SPACE + s if self.v.prefix and s else s)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self) > MOST_WORDS:
            self._forget()
        numbers = []
        for t in texts:
            words = self._cut(self.words(t)) if t else []
            numbers.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        if self.new:
            counts, ids = encode_words(self.v, self.new)
            self.new = []
            self.counts = np.r_[self.counts, counts]
            self.flat = np.r_[self.flat, ids]
            self.starts = np.cumsum(self.counts) - self.counts
        out = []
        for k in numbers:
            n = self.counts[k]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(k) else 0
            out.append(self.flat[np.repeat(self.starts[k] - ends + n, n) + np.arange(total)])
        return out

    def _cut(self, words: list[str]) -> list[str]:
        """Long runs of spaces in blocks: the blocks at their left are whole pieces whatever follows."""
        b = self.v.block
        if not b or max(map(len, words), default=0) <= LONG_RUN:
            return words
        out = []
        for w in words:
            run = len(w) - len(w.lstrip(SPACE))
            k = (run - 60) // b if run > LONG_RUN else 0
            out.extend([SPACE * b] * k)
            out.append(w[k * b:])
        return out


class Decoder:
    """ids -> text bytes: pieces with spaces for their sign, byte pieces as bytes, control pieces as nothing."""

    def __init__(self, v: Vocabulary):
        what = {CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.table = [what.get(k, lambda p: p.replace(SPACE, " ").encode())(p) for p, k in zip(v.pieces, v.kinds)]
        self.prefix = v.prefix

    def decode(self, ids) -> bytes:
        out = b"".join(map(self.table.__getitem__, ids))
        return out[1:] if self.prefix and out[:1] == b" " else out


def load(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary.read(f.read())


def chunks(column: pa.Array, size: int = CHUNK_BYTES):
    """The strings of a column, some ``size`` bytes together."""
    part, n = [], 0
    for x in column:
        t = x.as_py()
        part.append(t)
        n += len(t or "")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode(docs: DataFrame, vocabulary: Vocabulary, *, ids: bool = True) -> DataFrame:
    """Adds to ``doc_id``: ``ids`` (or, without, the digests of ``digest``) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the model file, a few MB

    def run(batches):
        enc, dec = Encoder(shared.value), Decoder(shared.value)
        names = [str(i) for i in range(len(shared.value.pieces))]
        for batch in batches:
            at = batch.schema.get_field_index("text")
            done = 0
            for part in chunks(batch.column(at)):
                found = enc.encode(part)
                key = batch.column(1 - at).slice(done, len(part))
                done += len(part)
                if ids:
                    flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "ids"])
                    continue
                count, codes, texts = [], [], []
                for f in found:
                    x = f.tolist()
                    count.append(len(x))
                    codes.append(hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest())
                    texts.append(hashlib.sha256(dec.decode(x)).hexdigest())
                yield pa.RecordBatch.from_arrays([key, pa.array(count, pa.int64()), pa.array(codes, pa.string()), pa.array(texts, pa.string())],
                                                 ["key", "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "ids array<int>" if ids else "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").alias("key"), "text").mapInArrow(run, f"key {kind}, {rest}").withColumnRenamed("key", "doc_id")


def digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    return encode(docs, vocabulary, ids=False)


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text for rows of doc_id, ids (null ids: the empty text). Bytes that aren't UTF-8 become U+FFFD."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        dec = Decoder(shared.value)
        for batch in batches:
            texts = [dec.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
