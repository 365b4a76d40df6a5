"""Toxicity by weak supervision.

From a bounded sample of labelled rows (``per_class`` of each class) lexicons are drawn up: words, and
beginnings of words, that toxic texts have far more often. The words are dealt by hash into ``PARTS``
lexicons and the beginnings by their length into one each; every lexicon is a voter, and another asks for
two different hits. Pattern voters (letters repeated, signs inside a word, letters set apart) know no labels.
A generative label model estimates by expectation-maximisation how accurate the voters are, starting from
the lexicons' votes; voters that correlate beyond what the class explains are put into one clique (of
at most ``MOST`` voters, a table of 2^MOST joint votes), so that they do not count twice. A sparse linear
classifier over words and beginnings of words is trained on the posteriors (not on the labels) and scores the texts.

Keys are 64-bit numbers. They are made and counted on the executors; the driver gets, of each sampled text, the
numbers of the keys that ``LEAST`` texts have, and no words.

Defined cases: null and empty texts get the score of the bias; without toxic labelled rows in reach every
score is 0; the number of a word's repeats in a text doesn't matter; ids, languages and sources don't
enter a score. Rows keep their null and repeated ids, each scored on its own; a repeated id is one row of the
sample (its smaller label and text), a null id none. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.llm.common import class_counts, labelled_sample, pieces, sigmoid, text_id, texts
from featlens.session import materialize

MODULUS, HELD = 4, 2
THRESHOLD = 0.3
PER_CLASS = 2000
#: Lengths in code points of the beginnings that are looked at; lexicons of whole words; texts that a key needs.
HEADS = (4, 5, 6)
PARTS = 8
LEAST = 3
#: Voters of a clique. Wider tables of joint votes are too thin for a few thousand texts (8 in place of 3: held-out
#: recall 0.49 in place of 0.83 at 10,000 documents); voters beyond it count as independent of the clique.
MOST = 3
#: Words written to be overlooked: a letter three times, signs or digits inside a word, single letters set apart.
PATTERNS = [re.compile(p) for p in (rb"([a-z])\1\1", rb"[a-z][0-9@$!*]+[a-z]", rb"\b(?:[a-z][.\-_ ]){3,}[a-z]\b")]
_CACHE = 300_000


def vocabulary(text: bytes | None) -> set[bytes]:
    """Distinct words of a text, A-Z lower-cased."""
    words: set[bytes] = set()
    for part in pieces((text or b"").lower()):
        words.update(part.split())
    return words


def keys(word: bytes) -> list[int]:
    """What the lexicons and the classifier see of a word: itself without punctuation around it, and its beginnings.

    A key's last four bits say which lexicon it may enter: the words' by hash, then one a length of beginnings.
    """
    s = word.decode("utf-8", "replace").strip(".,;:!?\"'()[]")
    if not s:
        return []
    h = xxhash.xxh3_64_intdigest(s.encode())
    out = [(h >> 4 << 4) | (h % PARTS)]
    out += [xxhash.xxh3_64_intdigest(s[:n].encode(), seed=n) >> 4 << 4 | PARTS + i for i, n in enumerate(HEADS) if len(s) > n]
    return [k - (1 << 64) if k >> 63 else k for k in out]


def lexicon_of(ids: np.ndarray) -> np.ndarray:
    return ids & 15


def patterns(text: bytes | None) -> int:
    """The votes of the pattern voters, one bit each."""
    t = (text or b"").lower()
    return sum(1 << i for i, p in enumerate(PATTERNS) if p.search(t))


def _key_sets(batches):
    for batch in batches:
        ids, marks = [], []
        for t in texts(batch):
            ids.append(np.array(sorted({k for w in vocabulary(t) for k in keys(w)}), np.int64))
            marks.append(patterns(t))
        get = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "y")]
        yield pa.RecordBatch.from_arrays([*get, pa.array(marks, pa.int32()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "y", "marks", "ids"])


@dataclass(frozen=True)
class Sample:
    """Texts as sparse rows: row ``r`` has the keys ``names[col[i]]`` of all i with ``row[i] == r``."""
    y: np.ndarray
    marks: np.ndarray
    row: np.ndarray
    col: np.ndarray
    names: np.ndarray

    def only(self, keep: np.ndarray) -> "Sample":
        """The same rows with the marked keys alone."""
        new = np.cumsum(keep) - 1
        on = keep[self.col]
        return Sample(self.y, self.marks, self.row[on], new[self.col[on]], self.names[keep])


def gather(sample: DataFrame, least: int = LEAST) -> Sample:
    """The sparse rows of ``doc_id, text, y``: keys are made, counted and picked on the executors."""
    kind = sample.schema["doc_id"].dataType.simpleString()
    sets = materialize(sample.mapInArrow(_key_sets, f"doc_id {kind}, y int, marks int, ids array<bigint>"))
    flat = sets.select("doc_id", F.explode("ids").alias("id"))
    known = flat.groupBy("id").count().where(F.col("count") >= least)
    kept = flat.join(known, "id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    got = sets.select("doc_id", "y", "marks").join(kept, "doc_id", "left").orderBy("doc_id").select("y", "marks", "ids").toArrow()
    y, marks = (got.column(c).to_numpy() for c in ("y", "marks"))
    ids = got.column("ids").combine_chunks()
    n = ids.value_lengths().fill_null(0).to_numpy() if len(ids) else np.empty(0, np.int64)
    names, col = np.unique(ids.flatten().to_numpy() if len(ids) else np.empty(0, np.int64), return_inverse=True)
    return Sample(y, marks, np.repeat(np.arange(len(y)), n), col, names)


def lexicons(s: Sample) -> np.ndarray:
    """The lexicon of each key, -1 for none: keys that toxic texts have at least fifty times as often."""
    size = len(s.names)
    seen = [np.bincount(s.col[s.y[s.row] == k], minlength=size) for k in (0, 1)]
    n = [max(1, int((s.y == k).sum())) for k in (0, 1)]
    good = (seen[1] >= LEAST) & (seen[1] / n[1] >= 50 * (seen[0] + 0.25) / n[0])
    return np.where(good, lexicon_of(s.names), -1)


def votes(s: Sample, lexicon: np.ndarray) -> np.ndarray:
    """0/1 votes, a row a text: the lexicons that have a key at all, two different hits, the patterns that occur."""
    size = PARTS + len(HEADS)
    on = lexicon[s.col] >= 0
    hits = np.bincount(s.row[on] * size + lexicon[s.col[on]], minlength=len(s.y) * size).reshape(-1, size)
    two = ((hits > 0).sum(1) > 1) | (hits.max(1, initial=0) > 1)
    marks = s.marks[:, None] >> np.arange(len(PATTERNS)) & 1
    return np.c_[hits[:, hits.any(0)] > 0, two, marks[:, marks.any(0)]].astype(np.int64)


def cliques(v: np.ndarray, y: np.ndarray, bound: float = 0.25, most: int = MOST) -> list[list[int]]:
    """Groups of voters whose votes still correlate once the (provisional) class is known."""
    groups = [[j] for j in range(v.shape[1])]
    centred = v - np.where(y[:, None], v[y].mean(0) if y.any() else 0, v[~y].mean(0) if (~y).any() else 0)
    sd = centred.std(0) + 1e-9
    corr = np.abs(centred.T @ centred / max(1, len(v)) / np.outer(sd, sd))
    for i, j in sorted(((i, j) for i in range(len(corr)) for j in range(i)), key=lambda p: -corr[p]):
        a, b = next(g for g in groups if i in g), next(g for g in groups if j in g)
        if corr[i, j] > bound and a is not b and len(a) + len(b) <= most:
            a.extend(b)
            groups.remove(b)
    return [sorted(g) for g in groups]


def label_model(v: np.ndarray, prior: float, anchors: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posterior probability of the class for every row of 0/1 votes, from the rows marked in ``anchors`` on."""
    post = np.where(anchors, 0.9, 0.02)
    groups = cliques(v, anchors)
    cells = [v[:, g] @ (1 << np.arange(len(g))) for g in groups]
    for _ in range(rounds):
        logit = np.full(len(v), np.log(prior / (1 - prior)))
        for g, c in zip(groups, cells):
            size = 1 << len(g)
            one, nil = (np.bincount(c, w, size) + 0.1 for w in (post, 1 - post))
            logit += (np.log(one / one.sum()) - np.log(nil / nil.sum()))[c]
        post = sigmoid(logit)
    return post


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict  # key -> weight, nonzero ones only
    bias: float

    def scorer(self):
        cache: dict[bytes, tuple] = {}

        def active(word: bytes) -> tuple:
            if len(cache) > _CACHE:
                cache.clear()
            found = cache[word] = tuple(k for k in keys(word) if k in self.weights)
            return found

        def score(text: bytes | None) -> float:
            hits: set[int] = set()
            for w in vocabulary(text):
                f = cache.get(w)
                hits.update(active(w) if f is None else f)
            return float(sigmoid(self.bias + sum(sorted(self.weights[k] for k in hits))))
        return score


def train(s: Sample, target: np.ndarray, active: float = 0.2) -> ToxicityModel:
    """The sparse classifier: an L1-penalised fit picks the keys (weights of at least ``active``), a second fit over
    these keys alone sets their weights, so that many small weights cannot add up in a long text."""
    first, _ = descend(s, target, penalty=1e-3)
    few = s.only(first >= active)
    w, bias = descend(few, target, penalty=2e-5)
    return ToxicityModel({k: x for k, x in zip(few.names.tolist(), w.tolist()) if abs(x) > 1e-6}, bias)


def descend(s: Sample, target: np.ndarray, penalty: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty (accelerated proximal gradient): the weight of each key, and the bias."""
    row, col, n, size = s.row, s.col, len(s.y), len(s.names)
    # every text weighs alike, each class half of the whole
    mass = np.where(target > 0.5, 0.5 / max(1e-9, (target > 0.5).sum()), 0.5 / max(1e-9, (target <= 0.5).sum()))
    scale = 1.0 / np.sqrt(np.maximum(1, np.bincount(col, minlength=size)))  # per-feature step sizes
    w, z, bias, zb, t = np.zeros(size), np.zeros(size), 0.0, 0.0, 1.0
    step = 0.5 / max(1e-9, float((mass[row] * 0.25 * scale[col] * np.bincount(row, scale[col], n)[row]).max(initial=0.0)) * n ** 0.5)
    step = min(step, 2e4)
    for _ in range(rounds):
        g = mass * (sigmoid(zb + np.bincount(row, z[col], n)) - target)
        v = z - step * scale * np.bincount(col, g[row], size)
        new = np.sign(v) * np.maximum(0.0, np.abs(v) - step * scale * penalty)
        nb = zb - 2.0 * g.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = new, nb, t2
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    n = class_counts(docs, labels, "toxic", MODULUS, HELD)
    s = gather(labelled_sample(docs, labels, "toxic", MODULUS, HELD, per_class))
    if not s.y.any():
        return ToxicityModel({}, -500.0)
    lexicon = lexicons(s)
    anchors = np.bincount(s.row[lexicon[s.col] >= 0], minlength=len(s.y)) > 0
    prior = min(0.5, max(0.01, n[1] / max(1, n[0] + n[1])))
    post = label_model(votes(s, lexicon), float(s.y.mean()), anchors)
    model = train(s, post)
    return ToxicityModel(model.weights, model.bias + min(0.0, float(np.log(prior / (1 - prior)) / 2)))


def score(docs: DataFrame, model: ToxicityModel, *, keep_row: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (with ``keep_row``, also the row as a struct)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's vocabulary
    extra = ["row"] if keep_row else []

    place = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            s = [of(t) for t in texts(pa.RecordBatch.from_arrays([batch.column("row").field(place)], ["text"]) if keep_row else batch)]
            names = ["doc_id", "held_out", *extra]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names],
                                              pa.array(s, pa.float64())], [*names, "score"])
    cols = [F.col("doc_id"), (text_id() % MODULUS == HELD).alias("held_out")]
    # the text once: a batch is 10,000 rows
    cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if keep_row else F.col("text"))
    d = docs.select(*cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "text")
    out = d.mapInArrow(run, f"{schema}, score double")
    return out.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, columns unchanged."""
    kept = score(docs, model, keep_row=True).where("predicted = 0")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
