"""Scans (S1-S4): the given parquet tables, CSV with pandas-like typing, nested JSON rows,
attribute tables filtered on a code, and ordered previews."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlens.functions.scalar import coerce_numeric

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The missing-value tokens pandas.read_csv recognises by default.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


# The texts read_csv takes for booleans.
BOOLEANS = ["True", "TRUE", "true", "False", "FALSE", "false"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load_csv(spark: SparkSession, path: str, target: str, schema=None,
             na_tokens=PANDAS_NA_TOKENS, **options) -> DataFrame:
    """Header CSV with pandas-like typing.

    Without an explicit schema every column is read as text, the pandas NA tokens become
    NULL, and one distributed aggregate decides per column whether all remaining values
    parse as BIGINT or DOUBLE, are the words for true and false with none missing (BOOLEAN),
    or stay STRING (no driver-side sampling of rows). Integers with missing values stay BIGINT.
    """
    reader = spark.read.options(header=True, **options)
    try:
        if schema is not None:
            df = reader.schema(schema).csv(path)
        else:
            df = reader.option("inferSchema", False).csv(path)
        df.schema  # forces path resolution
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(path) from exc
        raise
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not in {df.columns}")
    if schema is not None:
        return df
    tokens = F.array(*[F.lit(t) for t in na_tokens])
    cleaned = df.select([F.when(F.array_contains(tokens, F.trim(F.col(c))) | F.col(c).isNull(),
                                F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                         for c in df.columns])
    probes = []
    for i, c in enumerate(df.columns):
        v = F.col(c)
        probes += [F.count(v).alias(f"n{i}"),
                   F.count(coerce_numeric(v)).alias(f"d{i}"),
                   F.count(F.when(F.trim(v).try_cast("bigint").isNotNull()
                                  & ~F.trim(v).contains("."), 1)).alias(f"l{i}"),
                   F.count(F.when(v.isin(*BOOLEANS), 1)).alias(f"b{i}")]
    stats = cleaned.agg(F.count(F.lit(1)).alias("rows"), *probes).first()
    out = []
    for i, c in enumerate(df.columns):
        n, d, lg = stats[f"n{i}"], stats[f"d{i}"], stats[f"l{i}"]
        if n > 0 and lg == n:
            out.append(F.trim(F.col(c)).try_cast("bigint").alias(c))
        elif n > 0 and d == n:
            out.append(coerce_numeric(c).alias(c))
        elif n > 0 and stats[f"b{i}"] == n == stats["rows"]:
            out.append(F.col(c).cast("boolean").alias(c))
        else:
            out.append(F.col(c))
    return cleaned.select(out)


def nested_json_rows(doc: DataFrame, column: str = "value", mode: str = "FAILFAST") -> DataFrame:
    """A JSON array of arrays of strings; element 0 holds the column names.

    ``doc`` holds one JSON document per row (e.g. ``spark.read.text(path, wholetext=True)``);
    each document is exploded in parallel, and its values are named by its own element 0, so
    layouts may differ (a column that a document lacks is NULL). Only the distinct names reach
    the driver. A document that does not parse raises; ``mode="PERMISSIVE"`` leaves it out.
    """
    arr = doc.select(F.from_json(F.col(column), "array<array<string>>", {"mode": mode}).alias("a")).where(F.size("a") > 0)
    heads = arr.select(F.posexplode(F.col("a")[0]).alias("at", "name")).where(F.col("name").isNotNull())
    names = [r["name"] for r in heads.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    if not names:
        return doc.sparkSession.createDataFrame([], "dummy string").drop("dummy")
    rows = arr.select(F.col("a")[0].alias("h"), F.explode(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0)))).alias("r"))
    return rows.select([F.get("r", F.array_position("h", n).cast("int") - 1).alias(n) for n in names])


def scan_attributes(df: DataFrame, code_col: str, code, columns=None) -> DataFrame:
    """Attribute table filtered to one code; the predicate reaches the parquet scan."""
    out = df.filter(F.col(code_col) == F.lit(code))
    return out.select(*columns) if columns else out


def preview(df: DataFrame, key, n: int = 10) -> DataFrame:
    """First ``n`` rows in key order (TakeOrderedAndProject, no global sort)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)
