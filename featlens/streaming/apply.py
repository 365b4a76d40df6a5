"""Apply transforms fitted on a static table to each micro-batch of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame


def apply_fitted(stream: DataFrame, *models) -> DataFrame:
    """Chain ``model.transform`` (ImputerModel, OneHotModel, LabelModel, ScalerModel, ...)
    over a streaming DataFrame; every model's state is a static, bounded table."""
    out = stream
    for m in models:
        out = m.transform(out)
    return out
