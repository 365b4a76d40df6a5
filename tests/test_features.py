import pytest
import numpy as np
from pyspark.sql import functions as F

from featlens.operators import clean, features as G, profile


def test_quantile_bins_match_numpy_edges(spark):
    rng = np.random.default_rng(11)
    vals = rng.normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    out = G.create_binned_features(df, ["x"], 5, "quantile").collect()
    edges = np.percentile(vals, np.linspace(0, 100, 6))
    exp = np.searchsorted(edges[1:-1], vals, side="right")
    got = {r["x"]: r["x_BIN5"] for r in out}
    assert all(got[float(v)] == e for v, e in zip(vals, exp))


def test_binning_skips_nulls_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 2.0, 1.0), (3.0, 2.0, 3.0)], "a double, c double, n double")
    log = G.FeatureLog(original=df.columns)
    out = G.create_binned_features(df, ["a", "c", "n"], 2, "uniform", log=log)
    assert "a_BIN2" in out.columns and "c_BIN2" not in out.columns and "n_BIN2" not in out.columns
    assert [r["a_BIN2"] for r in out.orderBy("a").collect()] == [0.0, 1.0, 1.0]


def test_log_shift_and_skip(spark):
    df = spark.createDataFrame([(-2.0, 1.0), (0.0, 2.0), (3.0, 3.0)], "a double, b double")
    s = G.create_log_features(df, ["a"], "shift").orderBy("a").collect()
    assert abs(s[0]["a_LOG"] - np.log1p(1.0)) < 1e-12 and abs(s[2]["a_LOG"] - np.log1p(6.0)) < 1e-12
    k = G.create_log_features(df, ["a", "b"], "skip")
    assert "a_LOG" not in k.columns and "b_LOG" in k.columns


def test_ratio_zero_denominator_takes_median(spark):
    df = spark.createDataFrame([(1.0, 1.0), (4.0, 2.0), (9.0, 3.0), (5.0, 0.0)], "a double, b double")
    out = {r["a"]: r["a_DIV_b"] for r in G.create_interactions(df, [("a", "b")], "divide").collect()}
    assert out[5.0] == 2.0                      # median of [1, 2, 3]


def test_interactions_skip_unknown_and_all_kinds(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    out = G.create_interactions(df, [("a", "b"), ("a", "zz")], "all").first()
    assert (out["a_X_b"], out["a_PLUS_b"], out["a_MINUS_b"]) == (6.0, 5.0, -1.0)


def test_low_variance_guard(spark):
    df = spark.createDataFrame([(1.0, 0.001, 5.0), (2.0, 0.002, 6.0), (3.0, 0.001, 7.0)], "a double, t double, y double")
    assert G.remove_low_variance(df, "y", 0.01).columns == ["a", "y"]
    assert G.remove_low_variance(df, "y", 100.0).columns == ["a", "t", "y"]   # nothing would survive


def test_quartile_labels_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 9)], "x double")
    got = [r["x_bin"] for r in G.quartile_labels(df, "x").orderBy("x").collect()]
    assert got == ["Low", "Low", "Med-Low", "Med-Low", "Med-High", "Med-High", "High", "High"]


def test_kmeans_edges_two_clusters(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 0.1, 0.2, 10.0, 10.1, 10.2]], "x double")
    e = G.kmeans_edges(df, "x", 2, 0.0, 10.2)
    assert abs(e[1] - 5.1) < 1e-9 and e[0] == 0.0 and e[-1] == 10.2


def test_cut_and_custom(spark):
    df = spark.createDataFrame([(5.0,), (10.0,), (30.0,), (0.0,)], "s double")
    out, failed = G.create_custom(df, {"cls": lambda d: G.cut("s", [0, 10, 25, 50], ["a", "b", "c"]),
                                       "bad": lambda d: F.col("missing")})
    assert "bad" in failed
    assert [r["cls"] for r in out.orderBy("s").collect()] == [None, "a", "a", "c"]


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    out = clean.impute(df, "mode", ["c"]).collect()
    assert sorted(r["c"] for r in out) == ["a", "a", "a", "b", "b"]


def test_onehot_drops_first_level_and_label_nulls(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3), ("z", 4)], "c string, k int")
    oh = clean.onehot(df, ["c"]).orderBy("k").collect()
    assert list(oh[0].asDict()) == ["k", "c_y", "c_z"] and oh[2]["c_y"] == 0.0
    lab = {r["k"]: r["c"] for r in clean.label_encode(df, ["c"]).collect()}
    assert lab == {1: 1, 2: 2, 3: 0, 4: 3}     # 'nan' < 'x' < 'y' < 'z'


def test_missing_report_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    got = {r["column"]: r["n_missing"] for r in profile.missing_report(df).collect()}
    assert got == {"x": 2, "s": 1}


def test_dtype_counts_and_task_type(spark):
    df = spark.createDataFrame([(1.0, 1, "a")], "x double, k long, s string")
    assert {r["dtype"]: r["n_columns"] for r in profile.dtype_counts(df).collect()} == \
        {"float64": 1, "int64": 1, "object": 1}
    rows = spark.createDataFrame([(float(i % 20),) for i in range(100)], "t double")
    assert profile.task_type(rows, "t").first()["task_type"] == "classification"   # exactly 20 distinct
    assert profile.target_kind(rows, "t").first()["kind"] == "continuous"


def test_members_and_derived_tag(spark):
    from featlens.functions.scalar import is_derived
    from featlens.operators import select as L
    df = spark.createDataFrame([("a_X_b",), ("c",), ("d_POW2",)], "feature string")
    ids = spark.createDataFrame([("c",)], "feature string")
    assert [r["feature"] for r in L.members(df, ids).collect()] == ["c"]
    assert sorted(r["feature"] for r in L.non_members(df, ids).collect()) == ["a_X_b", "d_POW2"]
    assert [r["d"] for r in df.select(is_derived("feature").alias("d")).collect()] == [True, False, True]


@pytest.mark.parametrize("stretches", [G.KMEANS_STRETCHES, 7])
def test_kmeans_of_several_features_equals_lloyd_on_rows(spark, stretches):
    rng = np.random.default_rng(11)
    data = {"a": np.r_[rng.normal(-40, 1, 300), rng.normal(9, 3, 200)], "b": rng.integers(0, 30, 500).astype(float), "c": np.r_[np.full(400, 2.0), rng.exponential(50, 100)]}
    df = spark.createDataFrame([tuple(r) for r in zip(*[x.tolist() for x in data.values()])], "a double, b double, c double")
    got = G.kmeans_edges_of(df, list(data), 4, {f: (x.min(), x.max()) for f, x in data.items()}, stretches=stretches)
    for f, x in data.items():
        uni = np.linspace(x.min(), x.max(), 5)
        c = (uni[1:] + uni[:-1]) / 2
        while True:
            label = np.searchsorted((c[1:] + c[:-1]) / 2, x, side="left")
            new = np.array([x[label == k].mean() if (label == k).any() else c[k] for k in range(4)])
            moved, c = ((new - c) ** 2).sum(), new
            if moved <= 1e-4 * x.var():
                break
        assert np.allclose(got[f], [x.min(), *(c[1:] + c[:-1]) / 2, x.max()])
    with pytest.warns(UserWarning, match="still move"):
        G.kmeans_edges_of(df, ["a"], 4, {"a": (-45.0, 20.0)}, max_iter=1, tol=0.0)
