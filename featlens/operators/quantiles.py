"""Exact, distributed quantiles with linear interpolation (pandas/NumPy default).

Quantiles of whole columns are selected by bracket and count (``selection``). Quantiles within groups:
``percentile`` keeps a value->count map per group in one aggregation buffer, so a global
exact percentile over a continuous column finishes in one task holding every distinct
value. Here values collapse to (value, count) cells, cells fall into quantile buckets
(sketch cut points), bucket totals give each bucket's rank offset, and only the buckets
that contain a requested order statistic (at most two per quantile) are sorted; the two
cells straddling ``q * (n - 1)`` are interpolated. All joins against the bucket/target
tables are against tables of groups x buckets rows.
Set ``exact=False`` for ``percentile_approx`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlens.functions.scalar import normalise_nans
from featlens.operators.ranking import DEFAULT_BUCKETS, bucketize
from featlens.operators.selection import order_quantiles
from featlens.session import materialize


def _groups(group_cols) -> list[str]:
    if group_cols is None:
        return []
    return [group_cols] if isinstance(group_cols, str) else list(group_cols)


def quantiles(df: DataFrame, value_col: str, probs: list[float], group_cols=None,
              exact: bool = True, accuracy: int = 10000, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Long result ``(group..., q, value)``; NULL values are ignored; empty groups give no row."""
    g = _groups(group_cols)
    spark = df.sparkSession
    pdf = spark.createDataFrame([(float(p),) for p in probs], "q double")
    if not exact:
        qarr = F.array(*[F.lit(float(p)) for p in probs])
        agg = df.filter(F.col(value_col).isNotNull()).groupBy(*g).agg(
            F.percentile_approx(F.col(value_col), [float(p) for p in probs], accuracy).alias("_v"))
        return agg.select(*g, F.explode(F.transform(
            "_v", lambda v, i: F.struct(F.element_at(qarr, i + 1).alias("q"), v.alias("value")))).alias("e")
        ).select(*g, "e.q", "e.value")
    if not g:
        return spark.createDataFrame([(q, x) for _, q, x in order_quantiles(df, [value_col], probs)], "q double, value double")
    # NaN is missing, as NULL is
    df = normalise_nans(df)
    v = F.col(value_col)
    # one scan of the input: (value, count) cells, materialised as parquet in the checkpoint
    # folder; cut points and every later branch read that table, not the input
    cells = materialize(df.filter(v.isNotNull()).groupBy(*g, v.alias("_v")).agg(F.count(F.lit(1)).alias("cnt")))
    placed, nb = bucketize(cells, "_v", g, buckets)
    if nb == 1:
        return _quantiles_one_bucket(placed, g, probs)
    totals = placed.groupBy(*g, "_b").agg(F.sum("cnt").alias("_t"))
    wb = Window.partitionBy(*g).orderBy("_b")
    offsets = totals.select(*g, "_b", "_t", (F.sum("_t").over(wb) - F.col("_t")).alias("_o"),
                            F.sum("_t").over(Window.partitionBy(*g)).alias("_n"))
    targets = (offsets.select(*g, "_n").distinct().crossJoin(F.broadcast(pdf))
               .withColumn("_pos", F.col("q") * (F.col("_n") - 1))
               .withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos"))
               .withColumn("_frac", F.col("_pos") - F.col("_lo")))
    # buckets holding a target order statistic: <= 2 per (group, q)
    o, t = offsets.alias("o"), targets.alias("t")
    inb = lambda k: (F.col("o._o") <= F.col(f"t.{k}")) & (F.col(f"t.{k}") < F.col("o._o") + F.col("o._t"))
    hit = o.join(t, [F.col(f"o.{k}") == F.col(f"t.{k}") for k in g] + [inb("_lo") | inb("_hi")]) \
        .select(*[F.col(f"o.{k}").alias(k) for k in g], F.col("o._b").alias("_b"), F.col("o._o").alias("_o")) \
        .distinct()
    # prefix sums only inside the hit buckets (a few of ``buckets`` per group)
    sel = placed.join(F.broadcast(hit), g + ["_b"])
    wv = Window.partitionBy(*g, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sel.select(*g, "_v", "cnt", (F.col("_o") + F.coalesce(F.sum("cnt").over(wv), F.lit(0))).alias("before"))
    c = ranked.alias("c")
    lo_in = (F.col("c.before") <= F.col("t._lo")) & (F.col("t._lo") < F.col("c.before") + F.col("c.cnt"))
    hi_in = (F.col("c.before") <= F.col("t._hi")) & (F.col("t._hi") < F.col("c.before") + F.col("c.cnt"))
    cond = [F.col(f"t.{k}") == F.col(f"c.{k}") for k in g] + [lo_in | hi_in]
    hits = c.join(F.broadcast(t), cond).select(
        *[F.col(f"t.{k}").alias(k) for k in g], F.col("t.q").alias("q"), F.col("t._frac").alias("_frac"),
        F.when(lo_in, F.col("c._v")).alias("_lov"), F.when(hi_in, F.col("c._v")).alias("_hiv"))
    picked = hits.groupBy(*g, "q").agg(F.first("_frac").alias("_frac"), F.max("_lov").alias("_lov"),
                                       F.max("_hiv").alias("_hiv"))
    return picked.select(*g, "q", (F.col("_lov") + F.col("_frac") * (F.col("_hiv") - F.col("_lov"))).alias("value"))


def _quantiles_one_bucket(cells: DataFrame, g: list[str], probs: list[float]) -> DataFrame:
    """Every group's cells fit one window task: running counts over the cells, then the two
    cells straddling ``q * (n - 1)`` per requested q."""
    w = Window.partitionBy(*g).orderBy("_v")
    ranked = cells.select(*g, "_v", "cnt",
                          F.coalesce(F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                     F.lit(0)).alias("before"),
                          F.sum("cnt").over(Window.partitionBy(*g)).alias("_n"))
    t = (ranked.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
         .withColumn("_pos", F.col("q") * (F.col("_n") - 1))
         .withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos"))
         .withColumn("_frac", F.col("_pos") - F.col("_lo")))
    lo_in = (F.col("before") <= F.col("_lo")) & (F.col("_lo") < F.col("before") + F.col("cnt"))
    hi_in = (F.col("before") <= F.col("_hi")) & (F.col("_hi") < F.col("before") + F.col("cnt"))
    picked = t.filter(lo_in | hi_in).groupBy(*g, "q").agg(
        F.first("_frac").alias("_frac"), F.max(F.when(lo_in, F.col("_v"))).alias("_lov"),
        F.max(F.when(hi_in, F.col("_v"))).alias("_hiv"))
    return picked.select(*g, "q", (F.col("_lov") + F.col("_frac") * (F.col("_hiv") - F.col("_lov"))).alias("value"))


def quantile_long(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True) -> DataFrame:
    """Quantiles of several columns at once: ``(column, q, value)``, exact ones by selection (no value is shuffled)."""
    if exact:
        return df.sparkSession.createDataFrame(order_quantiles(df, cols, probs), "column string, q double, value double")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("e")
    ).select("e.column", "e.v")
    return quantiles(long, "v", probs, ["column"], exact=exact)


def median_map(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """One row per column: ``(column, median)``."""
    return quantile_long(df, cols, [0.5], exact).select("column", F.col("value").alias("median"))
