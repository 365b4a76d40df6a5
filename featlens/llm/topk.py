"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors become integers, ``floor(256 * x)`` for each component. They are range-partitioned by length (norm) and
packed into buckets sorted by it. The bucket of the longest vectors gives each query a lower bound of its
k-th best score. Against every bucket, the bound divided by the query's length and the bucket's longest
vector is the local cosine threshold: above 1 the bucket is skipped; otherwise a prefix of the bucket (length
pruning) or, from ``COSINE`` on, the vectors whose focus coordinates lie in the feasible region (coordinate
pruning) are verified by exact integer products.

Defined cases: see ``vectors``; zero vectors take part (score 0); fewer than k candidates give fewer rows.
Vectors whose integer product with themselves passes 64 bits (length 2^31.5, components of some 10^7) take no part:
the scores of all others then fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.llm import vectors as V
from featlens.session import materialize

K = 5
SCALE = 256
#: Local cosine threshold from which coordinates prune more than lengths alone.
COSINE, FOCUS = 0.7, 4
#: Products are taken in double precision while every partial sum is an exact integer, else in Python integers.
EXACT = 2.0 ** 52
#: Integer vectors this long or longer are left out: no product of shorter ones passes 64 bits.
LONGEST = 2.0 ** 31.5 * (1 - 1e-9)


def integers(df: DataFrame) -> DataFrame:
    """vec_id, v (whole numbers as double), dim, norm."""
    d = V.usable(df).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")))
    return d.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where(F.col("norm") < LONGEST)


def products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``q`` and ``m`` (as float64, or as Python integers if too large)."""
    if not q.size or not m.size or float(np.abs(q).max()) * float(np.abs(m).max()) * q.shape[1] < EXACT:
        return q @ m.T
    exact = lambda a: np.vectorize(int, otypes=[object])(a)
    return exact(q).dot(exact(m).T).astype(object)


def _best(q_ids, q, bounds, ids, m, k, length_only=False):
    """(query position, candidate positions, scores) of each query against one bucket, its rows sorted by falling length."""
    norm = np.sqrt((m * m).sum(1))
    q_norm = np.sqrt((q * q).sum(1))
    # length pruning: a candidate shorter than bound / |q| cannot reach the bound
    least = np.where(bounds > 0, bounds / np.maximum(q_norm, 1e-300) * (1 - 1e-9), -np.inf)
    upto = np.searchsorted(-norm, -least, side="right")
    live = np.flatnonzero(upto > 0)
    if not len(live):
        return
    longest = max(float(norm[0]), 1e-300)
    local = bounds / np.maximum(q_norm * longest, 1e-300)
    focus = live[(local[live] >= COSINE) & (bounds[live] > 0)] if not length_only else live[:0]
    plain = np.setdiff1d(live, focus)
    if len(plain):
        top = int(upto[plain].max())
        scores = products(q[plain], m[:top])
        for s, i in zip(scores, plain.tolist()):
            n = int(upto[i])
            s = np.where(ids[:n] == q_ids[i], -np.inf, s[:n].astype(np.float64)) if s.dtype != object else s[:n]
            if s.dtype == object:
                pos = np.array(sorted((j for j in range(n) if ids[j] != q_ids[i]), key=lambda j: (-s[j], ids[j]))[:k], np.int64)
            else:
                pos = V.local_best(s, ids[:n], k)
            yield i, pos, s[pos]
    if len(focus):
        unit = m / np.maximum(norm, 1e-300)[:, None]
        order = np.argsort(unit, axis=0, kind="stable")
        ranked = np.take_along_axis(unit, order, axis=0)
        for i in focus.tolist():
            t, n = min(1.0, float(local[i]) * (1 - 1e-9)), int(upto[i])
            qu = q[i] / q_norm[i]
            ok = None
            for f in np.argsort(-np.abs(qu))[:FOCUS].tolist():
                # the feasible region of coordinate f for a cosine of at least t
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - qu[f] * qu[f])))
                lo, hi = np.searchsorted(ranked[:, f], [t * qu[f] - spread - 1e-9, np.inf if qu[f] * 1.0 >= t else t * qu[f] + spread + 1e-9])
                if qu[f] <= -t:
                    lo = 0
                mark = np.zeros(len(m), bool)
                mark[order[lo:hi, f]] = True
                ok = mark if ok is None else ok & mark
            pos = np.flatnonzero(ok[:n] & (ids[:n] != q_ids[i]))
            if len(pos):
                s = products(q[i:i + 1], m[pos])[0].astype(np.float64)
                keep = V.local_best(s, ids[pos], k)
                yield i, pos[keep], s[keep]


def _sorted_bucket(batch, k, dim):
    ids, m = V.unpack(batch, k, dim, "ids", "matrix")
    order = np.argsort(-(m * m).sum(1), kind="stable")
    return ids[order], m[order]


def _cells(batch, *names):
    return [batch.column(batch.schema.get_field_index(c)) for c in names]


def search(df: DataFrame, k: int = K, every: int = V.QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each query (``vec_id % every = 0``)."""
    d = integers(df)
    parts = d.repartitionByRange(F.col("norm").desc()).sortWithinPartitions(F.col("norm").desc())
    buckets = materialize(V.blocks(parts, V.BLOCK_ROWS))
    queries = V.blocks(d.where(F.pmod("vec_id", F.lit(every)) == 0), V.QUERY_ROWS)

    # one bucket of each dimension, that of the longest vectors: bounded by BLOCK_ROWS rows of a vector each
    def longest(batches):
        for b in batches:
            n = [float((V.unpack(b, i, x.as_py(), "ids", "matrix")[1] ** 2).sum(1).max()) for i, x in enumerate(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.float64()), _cells(b, "block")[0]], ["dim", "norm", "block"])
    first = buckets.select("dim", "block", "ids", "matrix").mapInArrow(longest, "dim int, norm double, block string")
    first = first.groupBy("dim").agg(F.max_by("block", "norm").alias("b_"))
    seed = buckets.join(F.broadcast(first.select(F.col("b_").alias("block"), F.col("dim").alias("s_dim"))), "block")
    seed = seed.select("s_dim", F.col("ids").alias("s_ids"), F.col("matrix").alias("s_matrix"))

    def bound(batches):
        for b in batches:
            for i, x in enumerate(b.column(0)):
                q_ids, q = V.unpack(b, i, x.as_py(), "ids", "matrix")
                ids, m = V.unpack(b, i, x.as_py(), "s_ids", "s_matrix")
                order = np.argsort(-(m * m).sum(1), kind="stable")
                least = np.full(len(q), -np.inf)
                for j, pos, s in _best(q_ids, q, least.copy(), ids[order], m[order], k, length_only=True):
                    if len(pos) == k:
                        least[j] = float(s[-1])
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in _cells(b, "dim", "block", "ids", "matrix")],
                                                  pa.array([least.tobytes()], pa.binary())], ["dim", "block", "ids", "matrix", "bound"])
    # broadcast: else all query blocks of a dimension meet it in one task
    q = queries.join(F.broadcast(seed), queries.dim == seed.s_dim).select("dim", "block", "ids", "matrix", "s_ids", "s_matrix")
    q = q.mapInArrow(bound, "dim int, block string, ids binary, matrix binary, bound binary")
    q = materialize(q)

    def verify(batches):
        for b in batches:
            for i, x in enumerate(b.column(0)):
                dim = x.as_py()
                ids, m = _sorted_bucket(b, i, dim)
                q_ids, qm = V.unpack(b, i, dim, "q_ids", "q_matrix")
                bounds = np.frombuffer(_cells(b, "q_bound")[0][i].as_buffer(), "<f8")
                a, c, s = [], [], []
                for j, pos, score in _best(q_ids, qm, bounds, ids, m, k):
                    a.extend([int(q_ids[j])] * len(pos))
                    c.extend(ids[pos].tolist())
                    s.extend(map(int, score.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])
    pairs = V.against(q, buckets).select("dim", "ids", "matrix", "q_ids", "q_matrix", "q_bound")
    found = pairs.mapInArrow(verify, "query_id bigint, vec_id bigint, score bigint")
    return V.ranked(found, k, F.col("score"))
