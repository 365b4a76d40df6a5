"""Blocks of vectors, and searches of blocks of queries against all blocks.

Vectors are packed into blocks of bounded size (one row each: ids and a matrix), so that both a search's
queries and its candidates are read block by block; every block of candidates belongs to one of
``GROUPS`` groups and every block of queries goes to each group once, by an equi-join on the group.
The queries are copied ``GROUPS`` times at most, whatever the number of vectors.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part;
vectors of different lengths are never compared; rows without a vec_id take no part, and rows with the
same vec_id count as one (the lexicographically smaller vector).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
QUERY_ROWS = 512
GROUPS = 64
QUERY_EVERY = 50


def usable(df: DataFrame) -> DataFrame:
    """vec_id (long), v (array of double), dim: the rows that take part, one per vec_id."""
    d = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    d = d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    d = d.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return d.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def blocks(d: DataFrame, rows: int) -> DataFrame:
    """One row per block: dim, n, ids and matrix (bytes of int64 and float64), from a frame of dim, vec_id, v.

    Rows are blocked as they lie in their partition; a block never mixes dimensions.
    """
    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def close(dim):
            ids, mats = held.pop(dim)
            m = np.concatenate(mats)
            return pa.RecordBatch.from_arrays([
                pa.array([dim], pa.int32()), pa.array([len(m)]), pa.array([uuid.uuid5(uuid.NAMESPACE_OID, f"{dim}:{ids[0][0]}:{len(m)}").hex]),
                pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["dim", "n", "block", "ids", "matrix"])
        for batch in batches:
            dims = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            v = batch.column(2)
            flat = v.flatten().to_numpy()
            at = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                m = flat[at[mine][:, None] + np.arange(dim)]
                for lo in range(0, len(mine), rows):
                    i, x = held.setdefault(dim, ([], []))
                    i.append(ids[mine[lo:lo + rows]].astype("<i8"))
                    x.append(m[lo:lo + rows])
                    if sum(map(len, i)) >= rows:
                        yield close(dim)
        for dim in list(held):
            yield close(dim)
    return d.select("dim", "vec_id", "v").mapInArrow(run, "dim int, n bigint, block string, ids binary, matrix binary")


def unpack(batch, k: int, dim: int, ids: str, matrix: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of row ``k`` of an Arrow batch."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))[k].as_buffer()
    return np.frombuffer(get(ids), "<i8"), np.frombuffer(get(matrix), "<f8").reshape(-1, dim)


def against(queries: DataFrame, candidates: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Every block of queries (columns with ``q_`` in front) beside every block of candidates of its dimension.

    A merge join: the size that Catalyst estimates for the queries leaves out their ``groups`` copies, so a table
    of queries just below the broadcast threshold would go through the driver ``groups`` times as large."""
    c = candidates.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q_group"),
                       *[F.col(x).alias(f"q_{x}") for x in queries.columns])
    return c.join(q.hint("merge"), (c.group == q.q_group) & (c.dim == q.q_dim)).drop("group", "q_group", "q_dim", "q_block", "block")


def local_best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id; minus infinity never counts."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        pos = np.flatnonzero(score >= edge)
    else:
        pos = np.arange(len(score))
    pos = pos[score[pos] > -np.inf]
    return pos[np.lexsort((ids[pos], -score[pos]))[:k]]


def ranked(found: DataFrame, k: int, score: Column) -> DataFrame:
    """The ``k`` best of each query over all blocks: query_id, rank, vec_id, score."""
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
