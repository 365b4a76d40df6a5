"""Quality classifier with supervised subword embeddings.

A text is a bag of hashed features: its words, its character n-grams (bytes), and its word pairs (a
word repeated at once has a feature of its own). Every feature has a learned vector; a text is the
average of its vectors; a softmax over two outputs gives the score. Vectors and outputs are learned
together by numpy stochastic gradient descent (Adagrad steps) on a bounded sample of labelled rows
(``per_class`` of each class). As the output is linear in the average, scoring needs one number a
feature: the difference of the two outputs for its vector.

Defined cases: null and empty texts have no features and get the score of the learned bias; without
any labelled row every score is 0.5; with labels of one class only, the score is that class's prior;
texts over 1 MB are read in pieces cut at white space, and no feature spans two pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.llm.common import hashed_words, labelled_sample, mix64, pieces, sigmoid, text_id, texts

MODULUS, HELD = 3, 1
BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
PER_CLASS = 700
_REPEATED = 0  # the bucket of "the same word again"


class Features:
    """Feature numbers of a text, repeats included."""

    def of(self, text: bytes | None) -> Iterator[np.ndarray]:
        for part in pieces(text or b""):
            h = hashed_words(part)[1]
            yield self._bucket(h)
            pairs = self._bucket(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
            pairs[h[:-1] == h[1:]] = _REPEATED
            yield pairs
            b = np.frombuffer(part, np.uint8).astype(np.uint32)
            for n in GRAMS:
                if len(b) < n:
                    break
                acc = np.full(len(b) - n + 1, n, np.uint32)
                for i in range(n):
                    acc = (acc ^ b[i:len(b) - n + 1 + i]) * np.uint32(0x01000193)
                yield ((acc ^ (acc >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(15)) % np.uint32(BUCKETS - 1) + np.uint32(1)

    @staticmethod
    def _bucket(h: np.ndarray) -> np.ndarray:
        return (mix64(h) % np.uint64(BUCKETS - 1)).astype(np.uint32) + np.uint32(1)


def _bags(batches):
    """Executor side: the distinct features of each text with their counts."""
    features = Features()
    for batch in batches:
        ids, counts = [], []
        for t in texts(batch):
            parts = list(features.of(t))
            u, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint32), np.empty(0, np.int64))
            ids.append(u.astype("<u4").tobytes())
            counts.append(np.minimum(c, 65535).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")),
                                          pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["y", "ids", "counts"])


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # by feature: output 1 less output 0 of its vector
    bias: float

    def scorer(self):
        features = Features()

        def score(text: bytes | None) -> float:
            total, n = 0.0, 0
            for f in features.of(text):
                total += float(self.weights[f].sum(dtype=np.float64))
                n += len(f)
            return float(sigmoid(self.bias + (total / n if n else 0.0)))
        return score


def calibrate(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift that make ``sigmoid(scale * z + shift)`` fit the labels, both classes weighing alike."""
    x = np.stack([z / (z.std() + 1e-9), np.ones_like(z)], 1)
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    b = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ b)
        grad = x.T @ (w * (p - y)) + 1e-3 * b
        b -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    return float(b[0] / (z.std() + 1e-9)), float(b[1])


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], dims: int = 8, epochs: int = 10,
          rate: float = 0.05, seed: int = 7) -> QualityModel:
    """Stochastic gradient descent over (label, distinct features, counts). Every fourth row only calibrates the output."""
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    out = rng.normal(0, 0.5, (dims, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sv, so, sb = np.full(BUCKETS, 1e-8, np.float32), np.full((dims, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    shares = [(y, i, (c / c.sum(dtype=np.float64)).astype(np.float32)) for y, i, c in bags if len(i)]
    order = rng.permutation(len(shares))
    shares, aside = [shares[k] for k in order[len(order) // 4:]], [shares[k] for k in order[:len(order) // 4]]
    for _ in range(epochs):
        for k in rng.permutation(len(shares)):
            y, ids, w = shares[k]
            h = w @ vec[ids]
            z = h @ out + bias
            err = np.exp(z - z.max())
            err /= err.sum()
            err[y] -= 1
            gh = out @ err
            sv[ids] += (w * w) * float(gh @ gh) / dims
            vec[ids] -= (rate * w / np.sqrt(sv[ids]))[:, None] * gh
            go = np.outer(h, err)
            so += go * go
            out -= rate * go / np.sqrt(so)
            sb += err * err
            bias -= rate * err / np.sqrt(sb)
    weights, shift = vec @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])
    y = np.array([s[0] for s in aside])
    if 0 < y.sum() < len(y):
        z = np.array([w @ weights[i] for _, i, w in aside], np.float64) + shift
        scale, move = calibrate(z, y)
        weights, shift = weights * scale, shift * scale + move
    return QualityModel(weights.astype(np.float32), shift)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    sample = labelled_sample(docs, labels, "quality", MODULUS, HELD, per_class)
    rows = sample.orderBy("doc_id").mapInArrow(_bags, "y int, ids binary, counts binary").collect()
    bags = [(r.y, np.frombuffer(r.ids, "<u4"), np.frombuffer(r.counts, "<u2")) for r in rows]
    del rows
    got = [sum(b[0] == y for b in bags) for y in (0, 1)]
    if 0 in got:
        return QualityModel(np.zeros(BUCKETS, np.float32), 0.0 if not any(got) else 10.0 if got[1] else -10.0)
    return train(bags)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS numbers

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            s = [of(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")),
                                              batch.column(batch.schema.get_field_index("held_out")),
                                              pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", (text_id() % MODULUS == HELD).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double")
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
