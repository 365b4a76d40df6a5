import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from featlens.operators import assoc

# Golden Pearson matrix (6 decimals) of the reference's 442-row clinical table.
NAMES = ["age", "sex", "bmi", "bp", "s1", "s2", "s3", "s4", "s5", "s6", "target"]
LOWER = [
    [1.0],
    [0.173737, 1.0],
    [0.185085, 0.088161, 1.0],
    [0.335428, 0.241010, 0.395411, 1.0],
    [0.260061, 0.035277, 0.249777, 0.242464, 1.0],
    [0.219243, 0.142637, 0.261170, 0.185548, 0.896663, 1.0],
    [-0.075181, -0.379090, -0.366811, -0.178762, 0.051519, -0.196455, 1.0],
    [0.203841, 0.332115, 0.413807, 0.257650, 0.542207, 0.659817, -0.738493, 1.0],
    [0.270774, 0.149916, 0.446157, 0.393480, 0.515503, 0.318357, -0.398577, 0.617859, 1.0],
    [0.301731, 0.208133, 0.388680, 0.390430, 0.325717, 0.290600, -0.273697, 0.417212, 0.464669, 1.0],
    [0.187889, 0.043062, 0.586450, 0.441482, 0.212022, 0.174054, -0.394789, 0.430453, 0.565883, 0.382483, 1.0],
]


def golden_corr(spark):
    rows = []
    for i in range(len(NAMES)):
        for j in range(len(NAMES)):
            r = LOWER[max(i, j)][min(i, j)]
            rows.append((i, j, NAMES[i], NAMES[j], float(r), 442))
    return spark.createDataFrame(rows, "i int, j int, f1 string, f2 string, r double, n long")


def test_target_vector_golden(spark):
    tv = assoc.target_correlations(golden_corr(spark), "target").orderBy("rank").collect()
    assert [r["feature"] for r in tv] == ["bmi", "s5", "bp", "s4", "s3", "s6", "s1", "age", "s2", "sex"]


def test_multicollinearity_golden(spark):
    got = assoc.multicollinear_pairs(golden_corr(spark), "target", 0.85).collect()
    assert [(r["feature1"], r["feature2"]) for r in got] == [("s1", "s2")]


def test_suggestions_golden(spark):
    got = assoc.suggest_pairs(golden_corr(spark), "target", 0.15, 0.80, 10).orderBy("rank").collect()
    exp = [("bp", "s3", .649405), ("bmi", "age", .595191), ("bp", "s4", .591117), ("s3", "s1", .567734),
           ("bmi", "s1", .549172), ("bmi", "s3", .531328), ("s3", "age", .527920), ("bmi", "bp", .519863),
           ("bmi", "s2", .512228), ("s5", "bp", .511892)]
    assert len(got) == 10
    for r, (a, b, s) in zip(got, exp):
        assert {r["feature1"], r["feature2"]} == {a, b}
        assert abs(r["score"] - s) < 2e-5


def test_top_pairs_golden(spark):
    got = assoc.top_pairs(golden_corr(spark), "target", 10).orderBy("rank").collect()
    assert [(r["feature1"], r["feature2"]) for r in got[:3]] == [("s1", "s2"), ("s3", "s4"), ("s2", "s4")]


def test_pearson_pairwise_complete_and_constant(spark):
    rng = np.random.default_rng(3)
    n = 400
    a = rng.normal(size=n)
    b = a * 0.5 + rng.normal(size=n)
    c = np.full(n, 2.5)
    a_null = a.copy()
    a_null[::5] = np.nan
    pdf = pd.DataFrame({"a": a_null, "b": b, "c": c})
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in row) for row in pdf.values],
                               "a double, b double, c double").repartition(4)
    m = {(r["f1"], r["f2"]): r["r"] for r in assoc.pearson_matrix(df, ["a", "b", "c"]).collect()}
    exp = pdf.corr()
    assert abs(m[("a", "b")] - exp.loc["a", "b"]) < 1e-12
    assert abs(m[("b", "a")] - exp.loc["a", "b"]) < 1e-12
    assert m[("a", "c")] is None and m[("c", "c")] is None
    assert abs(m[("a", "a")] - 1.0) < 1e-12


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, 300).astype(float)
    y = x ** 2 + rng.integers(0, 30, 300)
    x[::7] = np.nan
    pdf = pd.DataFrame({"x": x, "y": y})
    df = spark.createDataFrame([(None if np.isnan(u) else float(u), float(v)) for u, v in zip(x, y)], "x double, y double")
    m = {(r["f1"], r["f2"]): r["r"] for r in assoc.spearman_matrix(df, ["x", "y"]).collect()}
    assert abs(m[("x", "y")] - pdf.corr(method="spearman").loc["x", "y"]) < 1e-12
