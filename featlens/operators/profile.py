"""Profiling (P1-P9). Every statistic is one distributed aggregate; results are
one-row or per-column DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType,
                               LongType, ShortType, StringType, TimestampNTZType, TimestampType)

from featlens.functions.scalar import is_missing, is_numeric_type, nan_to_null
from featlens.operators.quantiles import quantile_long

# Pandas dtype names for the Spark types we load.
PANDAS_DTYPE = {
    DoubleType: "float64", FloatType: "float32", LongType: "int64", IntegerType: "int32",
    ShortType: "int16", ByteType: "int8", StringType: "object", BooleanType: "bool",
    TimestampType: "datetime64[us]", TimestampNTZType: "datetime64[us]", DateType: "object",
}


def dtype_name(dtype) -> str:
    return PANDAS_DTYPE.get(type(dtype), dtype.simpleString())


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per dtype (schema metadata, no scan)."""
    rows = {}
    for f in df.schema.fields:
        rows[dtype_name(f.dataType)] = rows.get(dtype_name(f.dataType), 0) + 1
    return df.sparkSession.createDataFrame(sorted(rows.items()), "dtype string, n_columns bigint")


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column ``(column, pos, n_missing, n_rows)`` from one aggregate (NULL or NaN)."""
    cols = cols or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.when(is_missing(c, types[c]), 1)).alias(f"_m{k}") for k, c in enumerate(cols)])
    stacked = agg.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("pos"), F.col(f"_m{k}").alias("n_missing"))
        for k, c in enumerate(cols)])).alias("e"))
    return stacked.select("e.column", "e.pos", F.col("e.n_missing").cast("bigint").alias("n_missing"),
                          F.col("_rows").cast("bigint").alias("n_rows"))


def missing_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Columns with missing values: count and percent of all rows."""
    m = missing_counts(df, cols)
    return (m.filter(F.col("n_missing") > 0)
            .select("column", "n_missing",
                    (F.col("n_missing") * 100.0 / F.col("n_rows")).alias("pct_missing")))


def target_kind(df: DataFrame, target: str, max_classes: int = 20) -> DataFrame:
    """Categorical iff string/bool dtype or fewer than ``max_classes`` distinct values."""
    dtype = df.schema[target].dataType
    nd = df.agg(F.count_distinct(F.col(target)).alias("n_distinct"))
    forced = isinstance(dtype, (StringType, BooleanType))
    kind = F.lit("categorical") if forced else F.when(F.col("n_distinct") < max_classes, "categorical") \
        .otherwise("continuous")
    return nd.select(F.lit(target).alias("target"), kind.alias("kind"),
                     F.col("n_distinct").cast("bigint").alias("n_distinct"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Value, count, percent of *all* rows (nulls counted in the base, not listed)."""
    counts = df.groupBy(F.col(target).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))   # one row
    return (counts.filter(F.col("value").isNotNull()).crossJoin(F.broadcast(total))
            .select("value", F.col("count").cast("bigint").alias("count"),
                    (F.col("count") * 100.0 / F.col("_total")).alias("pct")))


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """P5: mean, sample std, min, max of a continuous target."""
    t = F.col(target).cast("double")
    return df.agg(F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"),
                  F.min(t).alias("min"), F.max(t).alias("max"))


def describe(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Count, mean, std, min, 25/50/75 % (linear), max per column."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("pos"), nan_to_null(F.col(c).cast("double")).alias("v"))
        for k, c in enumerate(cols)])).alias("e")).select("e.*")
    base = stacked.groupBy("column", "pos").agg(
        F.count("v").cast("bigint").alias("count"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantile_long(df, cols, [0.25, 0.5, 0.75], exact=exact)
    qw = q.groupBy("column").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value"))
    qw = qw.select("column", F.col("`0.25`").alias("p25"), F.col("`0.5`").alias("p50"), F.col("`0.75`").alias("p75"))
    return base.join(qw, "column", "left").select("column", "pos", "count", "mean", "std", "min",
                                                 "p25", "p50", "p75", "max")


def info(df: DataFrame, target: str) -> DataFrame:
    """P7 + P1 + P9: n_rows, n_cols, target, total missing cells, numeric columns (incl. target)."""
    n_numeric = sum(1 for f in df.schema.fields if is_numeric_type(f.dataType))
    m = missing_counts(df)
    return m.agg(F.first("n_rows").alias("n_rows"), F.sum("n_missing").cast("bigint").alias("missing_values")) \
        .select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"), F.lit(target).alias("target"),
                "missing_values", F.lit(n_numeric).cast("bigint").alias("numeric_features"))


def task_type(df: DataFrame, target: str, min_distinct: int = 20) -> DataFrame:
    """P8: 'regression' iff more than ``min_distinct`` distinct target values."""
    nd = df.agg(F.count_distinct(F.col(target)).alias("n_distinct"))
    return nd.select(F.lit(target).alias("target"), F.col("n_distinct").cast("bigint").alias("n_distinct"),
                     F.when(F.col("n_distinct") > min_distinct, "regression").otherwise("classification")
                     .alias("task_type"))


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("bigint"))


def numbered(df: DataFrame, order_cols: list, rank_col: str = "rank") -> DataFrame:
    """1..n numbering of an already small (feature-level or limited) table."""
    return df.withColumn(rank_col, F.row_number().over(Window.orderBy(*order_cols)).cast("bigint"))
