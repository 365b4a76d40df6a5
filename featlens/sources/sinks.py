"""Sinks (K1-K6): wide matrix CSV, result CSVs, model persistence, GeoJSON-style feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.operators.ranking import row_ids


def wide_matrix(corr: DataFrame, names: list[str]) -> DataFrame:
    """K1 (shape): long matrix -> square table, row label first, rows in column order.

    ``names`` is the matrix's own column list (p entries), so the pivot values are fixed
    up front and Spark does not run a distinct job to discover them.
    """
    wide = corr.groupBy("i", "f1").pivot("f2", names).agg(F.first("r"))
    return wide.orderBy("i").drop("i").withColumnRenamed("f1", "feature")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """K2-K4: header CSV. ``single_file`` only for feature-level (bounded) results."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)


def write_matrix_csv(corr: DataFrame, names: list[str], path: str) -> None:
    """K1: the square matrix (p rows) as one CSV file."""
    write_csv(wide_matrix(corr, names), path, single_file=True)


def save_models(models: dict, paths: dict) -> list[str]:
    """K5: persist every trained model; untrained (None) entries are skipped."""
    saved = []
    for name, model in models.items():
        if model is None or name not in paths:
            continue
        model.write().overwrite().save(paths[name])
        saved.append(paths[name])
    return saved


def feature_rows(df: DataFrame, key: str, geometry: str, properties: list[str]) -> DataFrame:
    """K6: one GeoJSON ``Feature`` per row with a sequential 0-based ``id`` in key order.

    Ids come from the distributed prefix-sum helper (no single-task window).
    """
    with_id = row_ids(df, key, "id", start=0)
    return with_id.select(
        "id", key,
        F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"),
                           F.struct(*[F.col(p) for p in properties]).alias("properties"),
                           F.col(geometry).alias("geometry"))).alias("feature"))
