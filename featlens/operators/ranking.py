"""Distributed ordered prefix sums and average ranks.

A global ``row_number() over (order by v)`` runs in one task. Instead:

1. collapse rows to cells ``(group, v, cnt)`` (map-side partial aggregation, so a value
   that holds a third of all rows is one cell),
2. cut each group's value range into ``buckets`` quantile buckets (``percentile_approx``
   over the cells, so buckets hold similar numbers of distinct values),
3. prefix-sum the per-bucket totals (groups x buckets rows, broadcast),
4. prefix-sum inside each (group, bucket) window and add the bucket offset.

Equal values always land in the same bucket, so ties are handled exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlens.session import materialize

DEFAULT_BUCKETS = 64
CUT_ACCURACY = 1000   # bucket cuts only balance work; rank error 1/1000 is plenty
# cells one (group, bucket) window task may sort; more cells -> another level of cuts
CELLS_PER_BUCKET = 2_000_000


def _lower_bound(v: Column, bounds: Column, lo: int, hi: int) -> Column:
    """Number of sorted ``bounds`` elements < v, as a balanced tree of CASE WHEN nodes:
    log2(len) comparisons per row, all inside whole-stage codegen (a higher-order
    ``filter`` lambda would be interpreted per element)."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(bounds.getItem(mid) < v, _lower_bound(v, bounds, mid + 1, hi)) \
        .otherwise(_lower_bound(v, bounds, lo, mid))


def bucketize(cells: DataFrame, order_col: str, g: list[str], buckets: int = DEFAULT_BUCKETS,
              per_group: bool = True) -> tuple[DataFrame, int]:
    """Add ``_b`` to materialised ``cells``: a bucket id that orders with ``order_col``
    (inside each group when ``per_group``), equal values always in one bucket.

    Each level cuts every current bucket into ``buckets`` parts with ``percentile_approx``
    cut points; levels are added until a bucket holds about ``CELLS_PER_BUCKET`` cells, so
    the later per-bucket window never sorts an unbounded share of the cells in one task.
    No level (one bucket per group) when the largest group's cells are within that bound.
    Returns the bucketed cells and the number of bucket ids per group.
    """
    if buckets <= 1:
        return cells.withColumn("_b", F.lit(0)), 1
    # scalars from the written cells: the total, and only when that exceeds the bound the
    # largest group's cell count (the window runs per group and bucket); with global cuts
    # the levels follow the total count
    total = cells.count()
    largest = total
    if total > CELLS_PER_BUCKET and g:
        largest = cells.groupBy(*g).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0
    if largest <= CELLS_PER_BUCKET:        # every group already fits one window task
        return cells.withColumn("_b", F.lit(0)), 1
    n = largest if per_group else total
    levels = 1
    while buckets ** levels * CELLS_PER_BUCKET < n:
        levels += 1
    probs = [i / buckets for i in range(1, buckets)]
    acc = max(CUT_ACCURACY, 16 * buckets)
    keys0 = list(g) if per_group else []
    out = cells
    for lv in range(levels):
        keys = keys0 + (["_b"] if lv else [])
        cuts = out.groupBy(*keys).agg(F.percentile_approx(F.col(order_col), probs, acc).alias("_cuts"))
        if not keys:
            joined = out.crossJoin(F.broadcast(cuts))                 # one row
        elif lv == 0:
            joined = out.join(F.broadcast(cuts), keys)               # one row per group (schema-bounded)
        else:
            joined = out.join(cuts, keys)      # groups x buckets^lv rows: Catalyst checks the size
        lb = _lower_bound(F.col(order_col), F.col("_cuts"), 0, buckets - 1)
        out = joined.withColumn("_b", lb if lv == 0 else F.col("_b") * buckets + lb).drop("_cuts")
        if lv + 1 < levels:
            out = materialize(out)
    return out, buckets ** levels


def _key_cols(group_cols) -> list[str]:
    if group_cols is None:
        return []
    return [group_cols] if isinstance(group_cols, str) else list(group_cols)


def ordered_cells(df: DataFrame, order_col: str, group_cols=None, weight: Column | None = None,
                  buckets: int = DEFAULT_BUCKETS, extra_sums: dict | None = None,
                  bounds: str = "group") -> DataFrame:
    """Per (group, value) cell: ``cnt`` (row or weight sum), ``before`` (sum of cnt over
    strictly smaller values in the group), ``dense_before`` (number of smaller distinct
    values), and for every ``extra_sums`` entry ``name`` the cell sum and ``name_before``.

    ``order_col`` must be numeric, date or timestamp; NULL values are dropped.

    ``bounds="group"`` cuts each group's own range (few, large groups: columns, pairs,
    classes); ``bounds="global"`` uses one set of cut points for all groups, for many
    small groups (the offsets are then joined, not broadcast).
    """
    g = _key_cols(group_cols)
    extra_sums = extra_sums or {}
    w = F.lit(1).cast("bigint") if weight is None else weight
    # one scan of the input; the cells (parquet in the checkpoint folder) feed the cut
    # points, the bucket totals and the placement branches
    cells = materialize(df.filter(F.col(order_col).isNotNull())
                        .groupBy(*g, order_col)
                        .agg(F.sum(w).alias("cnt"), *[F.sum(e).alias(k) for k, e in extra_sums.items()]))
    with_b, nb = bucketize(cells, order_col, g, buckets, per_group=not (bounds == "global" and g))
    sums = ["cnt"] + list(extra_sums)
    if nb == 1:     # each group is one bounded window: running sums directly, no offsets
        wv = Window.partitionBy(*g).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
        return with_b.select(
            *g, order_col, *sums,
            *[F.coalesce(F.sum(s).over(wv), F.lit(0)).alias("before" if s == "cnt" else f"{s}_before")
              for s in sums],
            F.coalesce(F.count(F.lit(1)).over(wv), F.lit(0)).alias("dense_before"))
    totals = with_b.groupBy(*g, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums],
                                          F.count(F.lit(1)).alias("_t_distinct"))
    wb = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*g, "_b", *[F.coalesce(F.sum(f"_t_{s}").over(wb), F.lit(0)).alias(f"_o_{s}")
                                        for s in sums + ["distinct"]])
    # groups x buckets rows: broadcast for per-group bounds (few groups, one level of
    # cuts), otherwise a plain join sized by Catalyst
    small = not (bounds == "global" and g) and nb <= DEFAULT_BUCKETS ** 2
    placed = with_b.join(F.broadcast(offsets) if small else offsets, g + ["_b"], "inner")
    wv = Window.partitionBy(*g, "_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select(
        *g, order_col, *sums,
        *[(F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(wv), F.lit(0))).alias(
            "before" if s == "cnt" else f"{s}_before") for s in sums],
        (F.col("_o_distinct") + F.coalesce(F.count(F.lit(1)).over(wv), F.lit(0))).alias("dense_before"))
    return out


def average_rank(df: DataFrame, order_col: str, group_cols=None, rank_col: str = "rank",
                 buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """pandas ``rank(method='average')`` per group, joined back to every row of ``df``."""
    g = _key_cols(group_cols)
    cells = ordered_cells(df, order_col, g, buckets=buckets).select(
        *g, order_col, (F.col("before") + (F.col("cnt") + 1) / 2.0).alias(rank_col))
    return df.join(cells, g + [order_col], "left")


def row_ids(df: DataFrame, key: str, id_col: str = "id", start: int = 0,
            buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Consecutive ids in ``key`` order (key must be unique and orderable)."""
    cells = ordered_cells(df, key, None, buckets=buckets).select(
        key, (F.col("before") + F.lit(start)).cast("bigint").alias(id_col))
    return df.join(cells, key, "inner")
