"""NaN is missing, infinities give no correlation, no caps on levels, no rows lost in splits."""

import pytest
from pyspark.sql import functions as F

from featlens.functions.scalar import coerce_numeric
from featlens.operators import assoc, clean, features, kendall, model, profile

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def holed(spark):
    return spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (NAN, 0.0), (5.0, 9.0)], "x double, y double")


def _r(matrix):
    return matrix.where("f1 = 'x' and f2 = 'y'").select("r", "n").first()


def test_rank_correlations_skip_nan(holed):
    s, k = _r(assoc.spearman_matrix(holed, ["x", "y"])), _r(kendall.kendall_matrix(holed, ["x", "y"]))
    assert s.n == 4 and s.r == pytest.approx(0.8)
    assert k.n == 4 and k.r == pytest.approx(2 / 3)
    assert kendall.kendall_pair(holed, "x", "y").first().tau == pytest.approx(2 / 3)


def test_describe_and_variance_skip_nan(holed):
    r = profile.describe(holed, ["x"]).first()
    assert (r["count"], r["mean"], r["max"], r.p50) == (4, 2.75, 5.0, 2.5)
    assert "x" in features.remove_low_variance(holed, None).columns


def test_pearson_is_null_with_infinities(spark):
    df = spark.createDataFrame([(1.0, 2.0), (INF, 1.0), (3.0, 4.0)], "x double, y double")
    assert _r(assoc.pearson_matrix(df, ["x", "y"])).r is None


def test_levels_have_no_limit(spark):
    df = spark.range(120_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("s"))
    got = clean.label_encode(df, ["s"]).agg(F.min("s"), F.max("s"), F.count_distinct("s")).first()
    assert tuple(got) == (0, 119_999, 120_000)
    assert len(clean.onehot(df.limit(1200), ["s"]).columns) == 1199
    few = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "s string")
    assert sorted(r.s for r in clean.label_encode(few).collect()) == [0, 1, 1, 2]


def test_splits_keep_every_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b"), (4, None), (5, None)], "k long, c string")
    assert df.count() == model.exact_split(df, "k").count() == model.stratified_split(df, "k", "c").count() == 5
    assert model.exact_split(df, "k").where("is_test").count() == 1
    assert model.stratified_split(df, "k", "c", test_size=0.4).where("is_test").count() == 2


def test_auc_ignores_rows_without_a_score(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (0, None), (1, None), (1, NAN), (0, 0.4)], "label int, score double")
    assert model.roc_auc(df).first().roc_auc == 1.0


def test_numbers_in_text(spark):
    rows = ["12d", "7F", "0x1p3", " 12 ", "-1.5e3", ".5", "5.", "", "1,0", None]
    got = [r.v for r in spark.createDataFrame([(r,) for r in rows], "s string").select(coerce_numeric("s").alias("v")).collect()]
    assert got == [None, None, None, 12.0, -1500.0, 0.5, 5.0, None, None, None]


def test_mode_of_one_and_of_many_columns(spark):
    rows = [(i % 3, None if i % 4 else "b" if i % 8 else "a", float(i // 2 % 5) if i % 2 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    want = [max(sorted({v for v in col if v is not None}), key=[v for v in col if v is not None].count) for col in zip(*rows)]
    for together in (32, 2, 1):
        assert list(clean._mode_row(df, ["a", "b", "c"], together).first()) == want
    assert list(clean._mode_row(df.select("b"), ["b"]).first()) == want[1:2]
    assert list(clean._mode_row(df.where("false"), ["a", "c"]).first()) == [None, None]
