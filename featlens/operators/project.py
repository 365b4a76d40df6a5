"""Projections and simple row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.functions.scalar import normalise_nans


def select_features(df: DataFrame, cols: list[str], target: str | None = None) -> DataFrame:
    """explicit projection, target appended last when given."""
    keep = [c for c in cols if c != target] + ([target] if target else [])
    return df.select(*keep)


def available(df: DataFrame, cols: list[str]) -> list[str]:
    """requested columns that exist, in request order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """drop rows with NULL/NaN in any of ``cols`` (NaN normalised first)."""
    return normalise_nans(df).dropna(subset=list(cols))


def filter_code(df: DataFrame, col: str, value) -> DataFrame:
    """equality filter (pushed into the scan)."""
    return df.filter(F.col(col) == F.lit(value))


def fill_const(df: DataFrame, mapping: dict) -> DataFrame:
    """constant fill per column (0, '')."""
    return df.fillna(mapping)
