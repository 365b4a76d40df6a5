import math

import numpy as np
from pyspark.sql import functions as F

from featlens.functions.student import t_two_sided
from featlens.operators import model as T, validate as D


def test_exact_split_size_disjoint_repeatable(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "k")
    a = T.exact_split(df, "k").filter("is_test").select("k").collect()
    b = T.exact_split(df, "k").filter("is_test").select("k").collect()
    assert len(a) == int(np.ceil(1003 * 0.2)) and sorted(a) == sorted(b)


def test_stratified_quotas(spark):
    rows = [(i, 0 if i < 300 else 1) for i in range(399)]
    df = spark.createDataFrame(rows, "k long, y int")
    got = {r["y"]: r["n"] for r in T.stratified_split(df, "k", "y").filter("is_test")
           .groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(got.values()) == 80 and got[0] == 60 and got[1] == 20


def test_regression_metrics_identities(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (3.0, 3.5)], "label double, prediction double")
    m = T.regression_metrics(df).first()
    assert abs(m["rmse"] - 0.5) < 1e-12 and abs(m["mae"] - 0.5) < 1e-12 and abs(m["r2"] - (1 - 0.75 / 2)) < 1e-12


def test_auc_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    s = rng.integers(0, 15, 200).astype(float)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(T.roc_auc(df).first()["roc_auc"] - exp) < 1e-12


def test_auc_null_for_three_classes(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "label int, score double")
    assert T.roc_auc(df).first()["roc_auc"] is None


def test_classification_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    m = T.classification_metrics(df).first()
    assert abs(m["accuracy"] - 2 / 3) < 1e-12 and abs(m["precision"] - (2 / 3) * (2 / 3)) < 1e-12


def exact_tail(t, d):
    """The finite sums that the two-sided tail has for whole degrees of freedom."""
    th, total = math.atan(t / math.sqrt(d)), 0.0
    term = math.sin(th) if d % 2 == 0 else math.sin(th) * math.cos(th) * 2 / math.pi
    for k in range(d // 2 if d % 2 == 0 else (d - 1) // 2):
        total += term
        term *= math.cos(th) ** 2 * ((2 * k + 1) / (2 * k + 2) if d % 2 == 0 else (2 * k + 2) / (2 * k + 3))
    return 1 - total - (0 if d % 2 == 0 else 2 / math.pi * th)


def test_t_distribution(spark):
    rows = [(t, d) for t in (0.0, 1e-9, 0.3, 1.0, 1.96, 2.0, 3.3, 7.0, 13.9, 14.1, 60.0, 1e9) for d in (1, 2, 3, 4, 5, 10, 30, 101, 196, 1000, 51383)]
    df = spark.createDataFrame(rows, "t double, d bigint")
    for r in df.select("t", "d", t_two_sided(F.col("t"), F.col("d")).alias("p"), t_two_sided(-F.col("t"), F.col("d")).alias("q")).collect():
        assert abs(r.p - exact_tail(r.t, r.d)) < 1e-10 and r.p == r.q, r
    odd = spark.createDataFrame([(None, 3), (float("nan"), 3), (2.0, 0), (2.0, None), (float("inf"), 3)], "t double, d bigint")
    assert [r[0] for r in odd.select(t_two_sided(F.col("t"), F.col("d"))).collect()] == [None, None, None, None, 0.0]
    far = spark.createDataFrame([(1e6, 2)], "t double, d bigint").select(t_two_sided(F.col("t"), F.col("d"))).first()[0]
    root = math.sqrt(2 + 1e12)      # small tails keep their digits
    assert abs(far / (2 / (root * (root + 1e6))) - 1) < 1e-9


def test_ols_r2_closed_form(spark):
    rng = np.random.default_rng(9)
    x1, x2 = rng.normal(size=300), rng.normal(size=300)
    y = 2 * x1 - x2 + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)], "a double, b double, y double")
    X = np.column_stack([np.ones(300), x1, x2])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    exp = 1 - ((y - X @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(T.ols_r2(df, ["a", "b"], "y") - exp) < 1e-10


def test_cv_folds_cover_rows(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i + 1) for i in range(200)], "k long, x double, y double")
    rows = D.cv_linear(df, "k", "x", "y", 5).collect()
    assert sum(r["n_test"] for r in rows) == 200
    assert all(abs(r["slope"] - 2.0) < 1e-9 and abs(r["r2"] - 1.0) < 1e-9 for r in rows)
