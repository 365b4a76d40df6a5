"""Column-level functions (JVM-side expressions only, no Python UDFs).

Every function returns a ``Column`` so it composes inside ``select``/``withColumns``
and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, BooleanType


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """pandas treats NaN as missing; Spark does not. Normalise on entry."""
    col = _c(c)
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def normalise_nans(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column (no-op for other types)."""
    fixes = {f.name: nan_to_null(f.name) for f in df.schema.fields
             if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(fixes) if fixes else df


def is_missing(c: str | Column, dtype=None) -> Column:
    col = _c(c)
    if dtype is not None and isinstance(dtype, (DoubleType, FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def is_numeric_type(dtype) -> bool:
    """``np.number`` semantics: numeric types, bool excluded."""
    return isinstance(dtype, NumericType) and not isinstance(dtype, BooleanType)


#: What counts as a number in text; a plain cast would also take Java's suffixes and hexadecimals.
NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def coerce_numeric(c: str | Column) -> Column:
    """``to_numeric(errors='coerce')`` — bad values become NULL instead of raising."""
    text = F.trim(_c(c).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def rate(num: str | Column, den: str | Column, scale: float = 100.0) -> Column:
    """``scale * num / den``; a zero denominator gives NULL (never raises)."""
    return F.lit(scale) * F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def key_concat(*cols: str | Column) -> Column:
    """F8: null-propagating string concatenation (``concat``, not ``concat_ws``)."""
    return F.concat(*[_c(c).cast("string") for c in cols])


def first_part(c: str | Column, sep: str = ",") -> Column:
    """first field of a delimited string."""
    return F.split_part(_c(c), F.lit(sep), F.lit(1))


def pct_label(c: str | Column, digits: int = 1) -> Column:
    """half-even rounding to ``digits`` decimals + '%'."""
    return F.concat(F.format_string(f"%.{digits}f", F.bround(_c(c), digits)), F.lit("%"))


def sign_class(c: str | Column) -> Column:
    """'positive' when r > 0 else 'negative'."""
    return F.when(_c(c) > 0, F.lit("positive")).otherwise(F.lit("negative"))


def is_derived(c: str | Column) -> Column:
    """a column name made by the interaction/power builders."""
    col = _c(c)
    return col.contains("_X_") | col.contains("_POW")


def clip(c: str | Column, lo: Column | float, hi: Column | float) -> Column:
    """clip to [lo, hi]."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo_c, F.least(_c(c), hi_c))


def signed(c: str | Column, decimals: int = 4) -> Column:
    """``%+.4f`` style."""
    return F.format_string(f"%+.{decimals}f", _c(c))


def thousands(c: str | Column, decimals: int = 0) -> Column:
    """thousands separators."""
    return F.format_number(_c(c), decimals)


def short_name(c: str | Column, n: int = 20) -> Column:
    """truncate names to ``n`` characters."""
    return F.substring(_c(c), 1, n)


def strength_band(r: str | Column) -> Column:
    """>0.5 strong, 0.15-0.5 moderate, <0.15 weak (on |r|)."""
    a = F.abs(_c(r))
    return (F.when(a > 0.5, "strong").when(a >= 0.15, "moderate")
            .when(a.isNotNull(), "weak"))


def recommendation_band(improvement: str | Column) -> Column:
    """>5 strong, >1 moderate, >-1 minimal, else degradation."""
    x = _c(improvement)
    return (F.when(x > 5, "strong").when(x > 1, "moderate").when(x > -1, "minimal")
            .when(x.isNotNull(), "degradation"))


def verdict(improvement: str | Column) -> Column:
    """>0 improved, < -1 degraded, else similar."""
    x = _c(improvement)
    return F.when(x > 0, "improved").when(x < -1, "degraded").otherwise("similar")


def pct_change(new: str | Column, base: str | Column) -> Column:
    """``(new - base) / base * 100``; base 0 gives NULL, sign of base is kept."""
    return F.try_divide(_c(new) - _c(base), _c(base)) * F.lit(100.0)
