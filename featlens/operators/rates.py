"""Regional rate analytics (J1, A1-A9, F15-F16, W3): rates joined to area attributes,
summary statistics, histogram, top-n, clipping and a least-squares trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlens.functions.scalar import clip, rate
from featlens.operators.quantiles import quantile_long, quantiles


def add_rates(df: DataFrame, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """``name -> (numerator, denominator)`` as ``100 * num / den`` (x/0 -> NULL)."""
    return df.withColumns({n: rate(a, b) for n, (a, b) in specs.items()})


def merge_rates(areas: DataFrame, rates: DataFrame, key: str, rate_col: str,
                suffixes=("_x", "_y")) -> DataFrame:
    """Areas LEFT JOIN rates on ``key``, clashing names suffixed, rows without a rate
    dropped (Catalyst turns the outer join into an inner one)."""
    clash = (set(areas.columns) & set(rates.columns)) - {key}
    a = areas.select([F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in areas.columns])
    r = rates.select([F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in rates.columns])
    rc = rate_col + suffixes[1] if rate_col in clash else rate_col
    return a.join(r, key, "left").dropna(subset=[rc])


def rate_stats(df: DataFrame, rate_col: str, count_cols: list[str], exact: bool = True) -> DataFrame:
    """A1: mean, median, max, min, sample std of the rate, integer sums, row count."""
    x = F.col(rate_col)
    base = df.agg(F.avg(x).alias("mean_rate"), F.max(x).alias("max_rate"), F.min(x).alias("min_rate"),
                  F.stddev_samp(x).alias("std_rate"), F.count(F.lit(1)).alias("n_areas"),
                  *[F.coalesce(F.sum(F.col(c)), F.lit(0)).cast("bigint").alias(f"total_{c}") for c in count_cols])
    med = quantiles(df, rate_col, [0.5], exact=exact).select(F.col("value").alias("median_rate"))
    return base.crossJoin(med)


def overall_rate(df: DataFrame, num: str, den: str, rate_col: str | None = None) -> DataFrame:
    """F16: ratio of sums ``100 * sum(num) / sum(den)`` (and, for contrast, mean of ratios)."""
    aggs = [(F.lit(100.0) * F.try_divide(F.sum(F.col(num)).cast("double"),
                                          F.sum(F.col(den)).cast("double"))).alias("overall_rate")]
    if rate_col:
        aggs.append(F.avg(rate_col).alias("mean_of_rates"))
    return df.agg(*aggs)


def quantile_value(df: DataFrame, col: str, q: float, exact: bool = True) -> DataFrame:
    """A2: one-row ``value`` of the q-quantile (linear interpolation)."""
    return quantiles(df, col, [q], exact=exact).select(F.col("value").alias(f"p{int(round(q * 100))}"))


def clip_to_quantile(df: DataFrame, col: str, q: float = 0.95, out_col: str | None = None) -> DataFrame:
    """clip to [0, p_q] with p_q from one distributed quantile (one-row broadcast)."""
    pq = quantile_value(df, col, q)
    name = pq.columns[0]
    out_col = out_col or f"{col}_clipped"
    return (df.crossJoin(F.broadcast(pq)).withColumn(out_col, clip(col, 0.0, F.col(name)))
            .drop(name))


def histogram(df: DataFrame, col: str, n_bins: int = 18) -> DataFrame:
    """A5: ``n_bins`` equal-width bins over [min, max] (last bin closed), empty bins kept."""
    rng = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    b = F.least(F.lit(n_bins - 1), F.floor(F.try_divide(F.col(col) - F.col("_lo"), width))).cast("int")
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(b)
    counts = (df.filter(F.col(col).isNotNull()).crossJoin(F.broadcast(rng)).select(b.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select(F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"), "_lo", "_hi")
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / n_bins).alias("left"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / n_bins).alias("right"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def top_n(df: DataFrame, col: str, key: str, n: int = 15) -> DataFrame:
    """``nlargest(n)`` (ties by key), returned in ascending rate order."""
    return df.orderBy(F.col(col).desc(), F.col(key)).limit(n).orderBy(F.col(col), F.col(key))


def axis_max(df: DataFrame, col: str, factor: float = 1.15) -> DataFrame:
    """``max * 1.15``."""
    return df.agg((F.max(col) * factor).alias("axis_max"))


def ols_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of y on x (complete rows)."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                  F.min(x).alias("x_min"), F.max(x).alias("x_max"))


def fitted_grid(df: DataFrame, x: str, y: str, n: int = 100) -> DataFrame:
    """The fitted line at ``n`` evenly spaced x in [min, max]."""
    fit = ols_line(df, x, y)
    xi = F.col("x_min") + F.col("i") * (F.col("x_max") - F.col("x_min")) / (n - 1)
    return fit.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "*") \
        .select(F.col("i").cast("bigint").alias("i"), xi.alias("x"),
                (F.col("intercept") + F.col("slope") * xi).alias("y_fit"))


def fitted_rows(df: DataFrame, x: str, y: str, out_col: str = "y_fit") -> DataFrame:
    """The fitted value at every row (one-row broadcast of the fit)."""
    fit = ols_line(df, x, y).select("slope", "intercept")
    return (df.crossJoin(F.broadcast(fit))
            .withColumn(out_col, F.col("intercept") + F.col("slope") * F.col(x)).drop("slope", "intercept"))


def grand_mean(df: DataFrame, col: str) -> DataFrame:
    """A4."""
    return df.agg(F.avg(col).alias("grand_mean"))


def group_mean_grid(df: DataFrame, row_col: str, col_col: str, value: str) -> DataFrame:
    """A3 (long form): mean of ``value`` per (row bin, column bin) plus the cell count."""
    return df.groupBy(row_col, col_col).agg(F.avg(value).alias("mean_value"),
                                            F.count(F.lit(1)).alias("n"))


def pivot_grid(grid: DataFrame, row_col: str, col_col: str, labels: list[str]) -> DataFrame:
    """A3 (wide form): pivot of the long grid with fixed labels (no distinct job)."""
    return grid.groupBy(row_col).pivot(col_col, labels).agg(F.first("mean_value"))


def percent_of(c: str | Column, total: str | Column) -> Column:
    return F.lit(100.0) * F.try_divide(F.col(c) if isinstance(c, str) else c,
                                       F.col(total) if isinstance(total, str) else total)


__all__ = ["add_rates", "merge_rates", "rate_stats", "overall_rate", "quantile_value", "clip_to_quantile",
           "histogram", "top_n", "axis_max", "ols_line", "fitted_grid", "fitted_rows", "grand_mean",
           "group_mean_grid", "pivot_grid", "quantile_long"]
