import os

from pyspark.sql import functions as F

from featlens.functions.scalar import recommendation_band, strength_band
from featlens.operators import model as T, validate as D
from featlens.sources import save_models


def test_compare_and_delta(spark):
    b = spark.createDataFrame([(0.40, 10.0, 8.0)], "r2 double, rmse double, mae double")
    e = spark.createDataFrame([(0.42, 9.0, 7.5)], "r2 double, rmse double, mae double")
    c = T.compare_models(b, e).withColumn("band", recommendation_band("improvement_pct")).first()
    assert c["metric"] == "r2" and abs(c["improvement_pct"] - 5.0) < 1e-9 and c["verdict"] == "improved"
    assert c["band"] == "moderate"
    d = {r["metric"]: r["delta"] for r in T.metric_delta(b, e).collect()}
    assert abs(d["rmse"] + 1.0) < 1e-12
    z = T.compare_models(b.withColumn("r2", F.lit(0.0)), e).first()
    assert z["improvement_pct"] is None




def test_strength_bands(spark):
    df = spark.createDataFrame([(0.6,), (-0.2,), (0.1,), (None,)], "r double")
    assert [r["b"] for r in df.select(strength_band("r").alias("b")).collect()] == ["strong", "moderate", "weak", None]


def test_bonferroni_and_complexity(spark):
    p = spark.createDataFrame([(0.001,), (0.02,), (0.3,)], "p_value double")
    got = sorted((r["p_value"], r["significant"]) for r in D.bonferroni(p).collect())
    assert got == [(0.001, True), (0.02, False), (0.3, False)]
    rows = spark.createDataFrame([(1000, 0.9, 0.5)], "n_rows long, train_r2 double, test_r2 double")
    c = D.complexity_check(rows, 19).first()
    assert c["within_budget"] and c["enough_rows"] and c["overfit"]


def test_train_importance_and_save(spark, tmp_path):
    rows = [(i, float(i), float(i % 7), 3.0 * i + (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    split = T.exact_split(df, "k")
    res = T.train_and_evaluate(split, ["a", "b"], "y", "regression", "linear")
    assert res.test_metrics.first()["r2"] > 0.99
    imp = T.feature_importance(res.model, ["a", "b"], 15, spark).orderBy("rank").collect()
    assert imp[0]["feature"] == "a"
    first = T.importance_first(T.feature_importance(res.model, ["a", "b"], None, spark), 1).collect()
    assert [r["feature"] for r in first] == ["a"]
    saved = save_models({"baseline": res.model, "enhanced": None},
                        {"baseline": str(tmp_path / "b"), "enhanced": str(tmp_path / "e")})
    assert saved == [str(tmp_path / "b")] and os.path.isdir(tmp_path / "b")
