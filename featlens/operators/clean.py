"""Imputation (M1-M7) and categorical encoding (E1-E3), split into fit and transform.

Fitted state is a one-row DataFrame (fill values) or a level table; applying it is a
broadcast of that bounded table, never a collect of data rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from featlens.functions.scalar import is_missing, is_numeric_type
from featlens.operators.profile import missing_counts
from featlens.operators.quantiles import median_map
from featlens.session import materialize

STRATEGIES = ("mean", "median", "mode", "drop")


def columns_with_missing(df: DataFrame) -> list[str]:
    """M5: every column holding a NULL/NaN (target included), in schema order."""
    row = missing_counts(df).filter("n_missing > 0").orderBy("pos").select("column").collect()
    return [r["column"] for r in row]   # at most one name per column


@dataclass(frozen=True)
class ImputerModel:
    strategy: str
    columns: tuple
    fill: DataFrame | None   # one row, one column per imputed column (None for 'drop')

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.columns:
            return df
        if self.strategy == "drop":
            cleaned = df
            for c in self.columns:
                cleaned = cleaned.filter(~is_missing(c, df.schema[c].dataType))
            return cleaned
        types = {f.name: f.dataType for f in df.schema.fields}
        joined = df.crossJoin(F.broadcast(self.fill))
        out = []
        for c in df.columns:
            if c in self.columns:
                fill = F.col(f"_fill_{self.columns.index(c)}")
                out.append(F.when(is_missing(c, types[c]), fill).otherwise(
                    F.col(c).cast(self.fill.schema[f"_fill_{self.columns.index(c)}"].dataType)).alias(c))
            else:
                out.append(F.col(c))
        return joined.select(out)


def fit_imputer(df: DataFrame, strategy: str = "median", columns: list[str] | None = None,
                exact: bool = True) -> ImputerModel:
    """M1-M5: fit fill values for ``columns`` (default: every column with a missing value)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    cols = tuple(columns_with_missing(df) if columns is None else columns)
    if not cols or strategy == "drop":
        return ImputerModel(strategy, cols, None)
    types = {f.name: f.dataType for f in df.schema.fields}
    if strategy in ("mean", "median"):
        bad = [c for c in cols if not is_numeric_type(types[c])]
        if bad:
            raise ValueError(f"strategy {strategy!r} needs numeric columns, got {bad}")
    clean = df.select([F.when(is_missing(c, types[c]), None).otherwise(F.col(c)).alias(c) for c in cols])
    if strategy == "mean":
        fill = clean.agg(*[F.avg(F.col(c).cast("double")).alias(f"_fill_{k}") for k, c in enumerate(cols)])
    elif strategy == "median":
        med = median_map(clean, list(cols), exact=exact)
        fill = med.groupBy().pivot("column", list(cols)).agg(F.first("median"))
        fill = fill.select([F.col(c).cast("double").alias(f"_fill_{k}") for k, c in enumerate(cols)])
    else:
        fill = _mode_row(clean, list(cols))
    return ImputerModel(strategy, cols, fill)


def _mode_row(df: DataFrame, cols: list[str], together: int = 32) -> DataFrame:
    """M3: most frequent value per column, smallest value on ties: one scan counts the values of ``together``
    columns as grouping sets, and one aggregate takes the best cell of each; no join, no sort of all values into one task."""
    row = None
    for start in range(0, len(cols), together):
        some = cols[start:start + together]
        d = df.select([F.col(f"`{c}`").alias(f"_m{start + k}") for k, c in enumerate(some)])
        counts = d.groupingSets([[F.col(c)] for c in d.columns], *d.columns).agg(F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_g"))
        best = []
        for k, c in enumerate(d.columns):
            own = ((1 << len(some)) - 1) ^ (1 << len(some) - 1 - k)         # the bit of a column that is grouped by is 0
            cell = F.when((F.col("_g") == own) & F.col(c).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v")))
            best.append(F.min(cell).getField("v").alias(f"_fill_{start + k}"))
        pick = counts.agg(*best)
        row = pick if row is None else row.crossJoin(pick)
    return row


def impute(df: DataFrame, strategy: str = "median", columns: list[str] | None = None) -> DataFrame:
    """``handle_missing_values``: fit on ``df`` and apply to ``df`` (M7 parity: fit on all rows)."""
    return fit_imputer(df, strategy, columns).transform(df)


def impute_audit(df: DataFrame, strategy: str = "median", columns: list[str] | None = None) -> DataFrame:
    """M6: values handled per column, counted before the fill; for 'drop' each column counts
    only rows that survived the earlier columns' drops."""
    cols = columns_with_missing(df) if columns is None else list(columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = []
    for k, c in enumerate(cols):
        cond = is_missing(c, types[c])
        if strategy == "drop":
            for prev in cols[:k]:
                cond = cond & ~is_missing(prev, types[prev])
        exprs.append(F.count(F.when(cond, 1)).alias(f"_a{k}"))
    agg = df.agg(*exprs)
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("pos"), F.lit(c).alias("column"), F.col(f"_a{k}").cast("bigint").alias("n_imputed"))
        for k, c in enumerate(cols)])).alias("e")).select("e.*").filter("n_imputed > 0")


# ---------------------------------------------------------------- encoding

def categorical_columns(df: DataFrame) -> list[str]:
    """String columns in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


@dataclass(frozen=True)
class OneHotModel:
    levels: dict          # column -> sorted levels (first is dropped)
    as_bool: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [F.col(c) for c in df.columns if c not in self.levels]
        dummies = []
        for c, lv in self.levels.items():
            for level in lv[1:]:
                ind = F.coalesce(F.col(c) == F.lit(level), F.lit(False))
                dummies.append((ind if self.as_bool else ind.cast("double")).alias(f"{c}_{level}"))
        return df.select(*keep, *dummies)


def fit_onehot(df: DataFrame, columns: list[str] | None = None, as_bool: bool = False) -> OneHotModel:
    """E1 fit: sorted distinct non-null levels per column. Every level becomes an output column,
    so the levels are collected as part of the schema; there is no limit on their number."""
    cols = categorical_columns(df) if columns is None else list(columns)
    levels = {}
    for c in cols:
        lv = df.select(F.col(c).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
        levels[c] = sorted(r["v"] for r in lv.collect())
    return OneHotModel(levels, as_bool)


def onehot(df: DataFrame, columns: list[str] | None = None, as_bool: bool = False) -> DataFrame:
    return fit_onehot(df, columns, as_bool=as_bool).transform(df)


@dataclass(frozen=True)
class LabelModel:
    codes: dict           # column -> DataFrame(level string, code bigint)
    null_token: str = "nan"

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, table in self.codes.items():
            key = F.coalesce(F.col(c).cast("string"), F.lit(self.null_token))
            lk = table.select(F.col("level").alias(f"_lv_{c}"), F.col("code").alias(f"_code_{c}"))
            # no hint: Catalyst broadcasts a small level table and sort-merges a large one
            out = (out.join(lk, key == F.col(f"_lv_{c}"), "left")
                   .withColumn(c, F.col(f"_code_{c}")).drop(f"_lv_{c}", f"_code_{c}"))
        return out.select(df.columns)


def _numbered_levels(levels: DataFrame) -> DataFrame:
    """``(level, code)``: 0-based positions in sorted order, any number of levels. The levels are
    range-partitioned, numbered inside each partition and shifted by the partitions before it."""
    parts = materialize(levels.repartitionByRange("level").withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)     # one row per partition
    sizes = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("level")) - 1
    numbered = parts.withColumn("_i", inside).join(sizes, F.col("_p") == F.col("_q"))
    return numbered.select("level", (F.col("_o") + F.col("_i")).cast("bigint").alias("code"))


def fit_label(df: DataFrame, columns: list[str] | None = None, null_token: str = "nan") -> LabelModel:
    """E2 fit: levels of ``cast(c as string)`` (NULL -> ``null_token``), sorted, 0-based codes."""
    cols = categorical_columns(df) if columns is None else list(columns)
    codes = {}
    for c in cols:
        lv = df.select(F.coalesce(F.col(c).cast("string"), F.lit(null_token)).alias("level")).distinct()
        codes[c] = _numbered_levels(lv)
    return LabelModel(codes, null_token)


def label_encode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return fit_label(df, columns).transform(df)


@dataclass(frozen=True)
class SparseOneHotModel:
    """E1 for columns of any number of levels: one sparse vector a row in place of a column a level.

    Levels are numbered where they are (range partitions), the first of each column has no place in the
    vector, and columns follow each other. ``sizes`` are the numbers of levels, the only figures at the driver."""
    codes: dict           # column -> DataFrame(level string, code bigint)
    sizes: dict           # column -> number of levels

    def _numbered(self, df: DataFrame) -> DataFrame:
        for k, (c, levels) in enumerate(self.codes.items()):
            known = levels.select(F.col("level").alias(f"_lv_{k}"), F.col("code").alias(f"_code_{k}"))
            # no hint: Catalyst broadcasts a small level table and sort-merges a large one
            df = df.join(known, F.col(c).cast("string") == F.col(f"_lv_{k}"), "left").drop(f"_lv_{k}")
        return df

    def transform(self, df: DataFrame, out: str = "onehot") -> DataFrame:
        """``df`` without the encoded columns, with ``out``: ``struct<size, indices, values>``, indices ascending.
        NULL, unknown and first levels have no entry."""
        kept = [c for c in df.columns if c not in self.codes]
        places, start = [], 0
        for k, c in enumerate(self.codes):
            code = F.col(f"_code_{k}")
            places.append(F.when(code > 0, (code + (start - 1)).cast("int")))
            start += max(self.sizes[c] - 1, 0)
        at = F.array_compact(F.array(*places)) if places else F.array().cast("array<int>")
        vector = F.struct(F.lit(start).alias("size"), at.alias("indices"), F.transform(at, lambda _: F.lit(1.0)).alias("values"))
        return self._numbered(df).select(*kept, vector.alias(out))

    def vectors(self, df: DataFrame, out: str = "features") -> DataFrame:
        """The same as a sparse vector of the learning library."""
        from pyspark.ml.feature import OneHotEncoder, VectorAssembler
        kept = [c for c in df.columns if c not in self.codes]
        d, names = self._numbered(df), []
        for k, c in enumerate(self.codes):
            n, code = max(self.sizes[c], 2), F.col(f"_code_{k}")
            # the encoder leaves out the last category: rows without an entry go there; with the number of categories named it scans nothing
            place = F.when(code > 0, code - 1).otherwise(n - 1).cast("double")
            d = d.withColumn(f"_at_{k}", place.alias(f"_at_{k}", metadata={"ml_attr": {"type": "nominal", "name": f"_at_{k}", "num_vals": n}}))
            names.append(f"_at_{k}")
        d = OneHotEncoder(inputCols=names, outputCols=[f"_v{x}" for x in names], dropLast=True).fit(d).transform(d)
        return VectorAssembler(inputCols=[f"_v{x}" for x in names], outputCol=out).transform(d).select(*kept, out)


def fit_onehot_sparse(df: DataFrame, columns: list[str] | None = None) -> SparseOneHotModel:
    """E1 fit: the sorted levels of every column with their numbers, in written tables."""
    cols = categorical_columns(df) if columns is None else list(columns)
    codes = {c: materialize(_numbered_levels(df.select(F.col(c).cast("string").alias("level")).where("level is not null").distinct())) for c in cols}
    return SparseOneHotModel(codes, {c: t.count() for c, t in codes.items()})


def encode_categorical(df: DataFrame, columns: list[str] | None = None, method: str = "onehot") -> DataFrame:
    """E1/E2 dispatcher; no categorical columns -> unchanged."""
    if method == "onehot":
        return onehot(df, columns)
    if method == "label":
        return label_encode(df, columns)
    raise ValueError(f"unknown encoding method {method!r}")
