"""Exact order statistics of many columns by bracket and count, and k-th smallest hashes.

A few order statistics need no sorted copy of their columns:

1. one aggregate sketches every column (``percentile_approx``) and gives, for each wanted quantile,
   a bracket some ranks wide around it,
2. one more scan counts the values below each bracket and keeps only those inside (some thousandths
   of the rows, equal values as one cell); the count below is a cell in front of them,
3. running sums over the kept cells reach the wanted ranks.

The sketch only has to be near: a rank that falls outside its bracket is seen by the counts, and the
scan is repeated for that one with the bracket open on the side where it fell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlens.functions.scalar import nan_to_null
from featlens.operators.ranking import ordered_cells
from featlens.session import materialize

#: The sketch is off by a 1/ACCURACY of the rows at most; a bracket reaches MARGIN times that to both sides.
ACCURACY = 1000
MARGIN = 2
#: Values that a task keeps before it hands on its cells.
KEPT = 1 << 19
_CELLS = "t int, v double, c bigint"
_ARROW = pa.schema([("t", pa.int32()), ("v", pa.float64()), ("c", pa.int64())])
_INF = float("inf")


def _sketch(df: DataFrame, cols: list[str], probs: list[float]) -> dict[int, tuple[int, list]]:
    """column number -> (values, brackets of the probabilities), from one aggregate of scalars."""
    off = MARGIN / ACCURACY
    ask = [min(1.0, max(0.0, p)) for q in probs for p in (q - off, q + off)]
    x = df.select([nan_to_null(F.col(f"`{c}`").cast("double")).alias(f"_x{k}") for k, c in enumerate(cols)])
    row = x.agg(*[F.count(f"_x{k}").alias(f"_n{k}") for k in range(len(cols))],
                *[F.percentile_approx(f"_x{k}", ask, ACCURACY).alias(f"_a{k}") for k in range(len(cols))]).first()
    return {k: (row[f"_n{k}"], [row[f"_a{k}"][i:i + 2] for i in range(0, len(ask), 2)])
            for k in range(len(cols)) if row[f"_n{k}"]}


def _keep(brackets: list[tuple[int, int, float, float]]):
    """Arrow batches of the columns -> cells ``(t, v, c)``: values inside the bracket of target ``t``, and in front
    of them (as -infinity) the number of values below it."""
    def cells(below, kept):
        t, v, c = [], [], []
        for number, _, lo, _ in brackets:
            if below[number]:
                t.append([number]), v.append([-_INF]), c.append([below[number]])
            if kept[number]:
                values, counts = np.unique(np.concatenate(kept[number]), return_counts=True)
                t.append(np.full(len(values), number)), v.append(values), c.append(counts)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], f.type) for x, f in zip((t, v, c), _ARROW)], schema=_ARROW)

    def run(batches):
        below, kept, held = dict.fromkeys((b[0] for b in brackets), 0), {b[0]: [] for b in brackets}, 0
        for batch in batches:
            column = {}
            for number, k, lo, hi in brackets:
                if k not in column:
                    x = np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.float64)
                    column[k] = x[~np.isnan(x)]
                x = column[k]
                below[number] += int((x < lo).sum())
                inside = x[(x >= lo) & (x <= hi)]
                if len(inside):
                    kept[number].append(inside)
                    held += len(inside)
            if held > KEPT:
                yield cells(below, kept)
                below, kept, held = dict.fromkeys(below, 0), {n: [] for n in kept}, 0
        yield cells(below, kept)
    return run


def order_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> list[tuple[str, float, float]]:
    """``(column, q, value)`` of exact quantiles with linear interpolation; NULL and NaN are missing,
    a column without values has none. Only ``len(cols) * len(probs)`` scalars reach the driver."""
    probs = [float(q) for q in probs]
    found = _sketch(df, cols, probs)
    wanted = dict(enumerate((k, i, n, *sorted(bracket)) for k, (n, brackets) in found.items() for i, bracket in enumerate(brackets)))
    values: dict[tuple[int, int], float] = {}
    x = df.select([F.col(f"`{c}`").cast("double").alias(f"_x{k}") for k, c in enumerate(cols)])
    while wanted:
        brackets = [(t, k, lo, hi) for t, (k, i, n, lo, hi) in wanted.items()]
        kept = x.mapInArrow(_keep(brackets), _CELLS)
        ranked = ordered_cells(kept, "v", ["t"], weight=F.col("c"))
        ranks = [(t, r) for t, (k, i, n, _, _) in wanted.items() for r in _around(probs[i], n)]
        ask = df.sparkSession.createDataFrame(sorted(set(ranks)), "t int, r bigint")      # two ranks a target
        hit = ranked.join(F.broadcast(ask), "t").where("before <= r and r < before + cnt").select("t", "r", "v").collect()
        at = {(h["t"], h["r"]): h["v"] for h in hit}
        missed = {}
        for t, (k, i, n, lo, hi) in wanted.items():
            ends = [at.get((t, r)) for r in _around(probs[i], n)]
            if None in ends or (-_INF in ends and lo > -_INF):
                # behind the bracket, or among the values counted below it
                missed[t] = (k, i, n, -_INF if -_INF in ends else lo, _INF if None in ends else hi)
            else:
                position = probs[i] * (n - 1)
                part = position - math.floor(position)
                values[k, i] = ends[0] if ends[0] == ends[1] else ends[0] + part * (ends[1] - ends[0])
        wanted = missed
    return [(cols[k], probs[i], values[k, i]) for k, i in sorted(values)]


def _around(q: float, n: int) -> tuple[int, int]:
    position = q * (n - 1)
    return math.floor(position), math.ceil(position)


# ---------------------------------------------------------------- k-th smallest of hashes

#: Hashes of HASH_BITS bits are counted by their first PART_BITS.
HASH_BITS, PART_BITS = 60, 16


def hash_threshold(df: DataFrame, hashed: str, share: float) -> tuple[int, int, int] | None:
    """(t, need, same): the rows with a hash below ``t`` and ``need`` of the ``same`` rows at ``t`` are the
    ``ceil(n * share)`` smallest; None without rows. The driver gets the counts by first bits (65536 at most)."""
    part = F.shiftright(F.col(hashed), HASH_BITS - PART_BITS)
    counts = sorted((r[0], r[1]) for r in df.groupBy(part.alias("_p")).agg(F.count(F.lit(1))).collect())
    if not counts:
        return None
    quota = math.ceil(sum(c for _, c in counts) * share)
    if quota <= 0:
        return -1, 0, 0
    for p, c in counts:
        if quota <= c:
            break
        quota -= c
    cells = ordered_cells(df.select(hashed).where(part == p), hashed)
    row = cells.where((F.col("before") < quota) & (F.col("before") + F.col("cnt") >= quota)).first()
    return row[hashed], quota - row["before"], row["cnt"]


def hash_thresholds(df: DataFrame, hashed: str, quotas, group: str) -> DataFrame:
    """``(group, _t, _need)`` for every group of ``df``: the rows with a hash below ``_t`` and ``_need`` of
    those at ``_t`` are the group's ``quota`` smallest; ``_same`` rows are at ``_t``.

    ``quotas`` makes of ``(group, n)`` a table ``(group, quota)``. Two scans of the hash: one counts by
    the first bits, the second keeps the one part in 65536 in which the quota falls.
    """
    part = F.shiftright(F.col(hashed), HASH_BITS - PART_BITS)
    counts = materialize(df.groupBy(group, part.alias("_p")).agg(F.count(F.lit(1)).alias("_c")))
    quota = quotas(counts.groupBy(group).agg(F.sum("_c").alias("n")))
    along = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("_before", F.coalesce(F.sum("_c").over(along), F.lit(0))).join(quota, group)
    hit = ahead.where("_before < quota and quota <= _before + _c").select(F.col(group).alias("_g"), F.col("_p").alias("_q"), "_before", "quota")
    kept = df.select(group, hashed, part.alias("_p")).join(hit, (F.col(group) == F.col("_g")) & (F.col("_p") == F.col("_q")), "left_semi")
    cells = ordered_cells(kept, hashed, [group])
    rest = F.col("quota") - F.col("_before") - F.col("before")
    at = cells.join(hit, F.col(group) == F.col("_g")).where((rest > 0) & (rest <= F.col("cnt"))).select(
        group, F.col(hashed).alias("_t"), rest.alias("_need"), F.col("cnt").alias("_same"))
    none = quota.where("quota <= 0").select(group, F.lit(-1).cast("long").alias("_t"), F.lit(0).cast("long").alias("_need"), F.lit(0).cast("long").alias("_same"))
    return materialize(at.unionByName(none))
