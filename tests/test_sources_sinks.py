import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlens.operators import features as G, kendall, project
from featlens.sources import feature_rows, load_csv, nested_json_rows, wide_matrix, write_matrix_csv


def test_kendall_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, 250).astype(float)
    y = x + rng.integers(0, 9, 250)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    row = kendall.kendall_pair(df, "x", "y").first()
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    iu = np.triu_indices(len(x), 1)
    s = (dx * dy)[iu]
    n1 = (dx[iu] == 0).sum(); n2 = (dy[iu] == 0).sum(); n0 = len(s)
    exp = s.sum() / np.sqrt((n0 - n1) * (n0 - n2))
    assert row["n_discordant"] == int((s < 0).sum())
    assert abs(row["tau"] - exp) < 1e-12


def _tau_b(x, y):
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    iu = np.triu_indices(len(x), 1)
    s = (dx * dy)[iu]
    n1 = (dx[iu] == 0).sum(); n2 = (dy[iu] == 0).sum(); n0 = len(s)
    return s.sum() / np.sqrt((n0 - n1) * (n0 - n2))


def test_kendall_matrix_pairwise_complete(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 15, 200).astype(float)
    b = a - rng.integers(0, 6, 200)
    c = rng.normal(size=200).round(1)
    a[::9] = np.nan
    c[::13] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(a, b, c)],
                               "a double, b double, c double")
    got = {(r["f1"], r["f2"]): (r["r"], r["n"]) for r in kendall.kendall_matrix(df, ["a", "b", "c"]).collect()}
    cols = {"a": a, "b": b, "c": c}
    for f1 in cols:
        for f2 in cols:
            ok = ~np.isnan(cols[f1]) & ~np.isnan(cols[f2])
            r, n = got[(f1, f2)]
            assert n == ok.sum()
            assert abs(r - _tau_b(cols[f1][ok], cols[f2][ok])) < 1e-12


def test_load_csv_types_and_na_tokens(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c,target\n1,2.5,x,1\nNA,nan,y,2\n3,,NULL,3\n")
    df = load_csv(spark, str(p), "target")
    types = dict(df.dtypes)
    assert types["a"] == "bigint" and types["b"] == "double" and types["c"] == "string"
    rows = df.orderBy("target").collect()
    assert rows[1]["a"] is None and rows[1]["b"] is None and rows[2]["c"] is None
    with pytest.raises(ValueError):
        load_csv(spark, str(p), "nope")
    with pytest.raises(FileNotFoundError):
        load_csv(spark, str(tmp_path / "missing.csv"), "target")


def test_nested_json_rows(spark):
    doc = spark.createDataFrame([('[["NAME","B1","state"],["Tract 1, X","100","25"],["Tract 2, X","7","25"]]',)],
                                "value string")
    out = nested_json_rows(doc).orderBy("B1").collect()
    assert [r["B1"] for r in out] == ["100", "7"] and out[0]["NAME"] == "Tract 1, X"


def test_wide_matrix_and_csv(spark, tmp_path):
    rows = [(i, j, n1, n2, 1.0 if i == j else 0.5, 3) for i, n1 in enumerate("ab") for j, n2 in enumerate("ab")]
    corr = spark.createDataFrame(rows, "i int, j int, f1 string, f2 string, r double, n long")
    w = wide_matrix(corr, ["a", "b"]).collect()
    assert [r["feature"] for r in w] == ["a", "b"] and w[0]["b"] == 0.5
    write_matrix_csv(corr, ["a", "b"], str(tmp_path / "m"))
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "m"))


def test_feature_rows_sequential_ids(spark):
    df = spark.createDataFrame([(30, "g3", 1.5), (10, "g1", 2.5), (20, "g2", 3.5)], "k long, geom string, rate double")
    out = sorted(feature_rows(df, "k", "geom", ["rate"]).collect(), key=lambda r: r["id"])
    assert [r["k"] for r in out] == [10, 20, 30]
    f = json.loads(out[0]["feature"])
    assert f["type"] == "Feature" and f["id"] == 0 and f["properties"]["rate"] == 2.5


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (float("nan"), 2.0, None)], "x double, y double, s string")
    assert project.available(df, ["y", "zz", "x"]) == ["y", "x"]
    assert project.select_features(df, ["x", "y"], "s").columns == ["x", "y", "s"]
    assert project.drop_missing(df, ["x"]).count() == 1
    assert project.fill_const(df, {"s": "", "y": 0.0}).filter("s = '' OR y = 0.0").count() == 2
    assert project.filter_code(df, "s", "a").count() == 1


def test_feature_summary(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    log = G.FeatureLog(original=df.columns)
    out = G.create_polynomials(G.create_interactions(df, [("a", "b")], "multiply", log=log), ["a"], 3, log=log)
    s = G.feature_summary(spark, log).first()
    assert (s["created_features"], s["interaction_features"], s["polynomial_features"]) == (3, 1, 2)
    assert s["feature_list"] == ["a_X_b", "a_POW2", "a_POW3"] and "a_POW3" in out.columns
