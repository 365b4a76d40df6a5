"""Query registry: each key pairs a Spark plan with an equivalent DuckDB/ANSI SQL oracle.

Doubles are rounded to 6 decimals on both sides (and -0.0 folded into 0.0) so the
order-insensitive value hash compares results, not last-bit arithmetic differences.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from featlens.session import owned_tables


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple = field(default_factory=tuple)


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, doubles=()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, tuple(doubles))
        return fn
    return deco


def _round_half_away(x, digits: int):
    """``sign(x) * floor(|x| * 10^d + 0.5) / 10^d`` with the same IEEE steps as the SQL side
    (Spark's ``round`` rounds the shortest decimal string, DuckDB the scaled double)."""
    scale = float(10 ** digits)
    r = F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(F.abs(x) < F.lit(1e12), r).otherwise(x) + F.lit(0.0)


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    fixes = {f.name: _round_half_away(F.col(f.name).cast("double"), digits)
             for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(fixes) if fixes else df


def wrap_sql(sql: str, doubles, digits: int = 6) -> str:
    if not doubles:
        return sql
    scale = float(10 ** digits)
    rep = ", ".join(
        f'CASE WHEN abs(CAST("{c}" AS DOUBLE)) < 1e12 THEN sign(CAST("{c}" AS DOUBLE)) * '
        f'floor(abs(CAST("{c}" AS DOUBLE)) * {scale!r} + 0.5) / {scale!r} ELSE CAST("{c}" AS DOUBLE) END + 0.0 AS "{c}"'
        for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(e: Entry):
        return lambda spark, sf_dir: finish(e.build(spark, sf_dir))
    return {k: bind(e) for k, e in REGISTRY.items()}


def write_query(name: str, spark: SparkSession, sf_dir: str, path: str) -> None:
    """Runs a registered query, writes its result as Parquet and removes the tables it wrote on the way."""
    with owned_tables(spark):
        spark_queries()[name](spark, sf_dir).write.parquet(path)


def oracle_queries() -> dict[str, str]:
    return {k: wrap_sql(e.sql, e.doubles) for k, e in REGISTRY.items() if e.sql is not None}
