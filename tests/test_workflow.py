import numpy as np
import pytest

from featlens.operators import model as T
from featlens.sources import load_csv, nested_json_rows


def rows_of(classes, n=240, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    return [(i, float(v + rng.normal(0, .3)), float(-v + rng.normal(0, .6)), int(v)) for i, v in enumerate(y)]


def test_boosting_takes_three_classes(spark):
    df = T.stratified_split(spark.createDataFrame(rows_of(3), "k long, a double, b double, y int"), "k", "y")
    res = T.train_and_evaluate(df, ["a", "b"], "y", "classification", "gradient_boosting", maxIter=5)
    m = res.test_metrics.first()
    assert m["accuracy"] > 0.8 and m["roc_auc"] is None and res.classes == (0, 1, 2)
    res.release()


def test_classifier_record_has_auc_and_text_classes(spark):
    df = spark.createDataFrame([(k, a, b, ("no", "yes")[y]) for k, a, b, y in rows_of(2)], "k long, a double, b double, y string")
    res = T.train_and_evaluate(T.stratified_split(df, "k", "y"), ["a", "b"], "y", "classification", "logistic")
    r = res.record().first()
    assert r["model_name"] == "logistic" and r["n_features"] == 2 and res.classes == ("no", "yes")
    scored = [(x["label"], x["probability"][1]) for x in res.test_predictions.select("label", "probability").collect()]
    pos, neg = ([s for y, s in scored if y == v] for v in (1.0, 0.0))
    exact = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(r["test_roc_auc"] - exact) < 1e-12 and r["train_accuracy"] > 0.8


def test_logistic_has_a_penalty_by_default():
    learner = T.make_learner("classification", "logistic", rows=200)
    assert learner.getRegParam() == 1 / 200


def test_workflow_uses_one_split_and_saves(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([(i, float(x), None if i % 17 == 0 else float(z), float(x * z)) for i, (x, z) in enumerate(zip(a, b))],
                               "k long, a double, b double, y double")
    run = T.baseline_and_enhanced(df, "k", "y", "regression", [("a", "b")], model_type="linear", save_to=str(tmp_path))
    assert run.baseline.features == ["a", "b"] and len(run.enhanced.features) == 3
    assert run.baseline.test_predictions.count() == run.enhanced.test_predictions.count() == 60
    r = run.comparison.first()
    assert r["enhanced_r2"] > 0.8 > r["baseline_r2"]
    assert (tmp_path / "baseline").exists() and (tmp_path / "enhanced").exists()


def test_json_documents_with_other_layouts(spark):
    docs = spark.createDataFrame([('[["A","B"],["1","2"]]',), ('[["B","A"],["3","4"],["5"]]',), ('[["A"]]',), (None,)], "value string")
    got = sorted(tuple(r) for r in nested_json_rows(docs).select("A", "B").na.fill("-").collect())
    assert got == [("-", "5"), ("1", "2"), ("4", "3")]
    bad = docs.union(spark.createDataFrame([('[["A"',)], "value string"))
    assert nested_json_rows(bad, mode="PERMISSIVE").count() == 3
    with pytest.raises(Exception):
        nested_json_rows(bad).collect()


def test_csv_booleans_and_codes_that_look_like_java_numbers(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("flag,holes,code,target\nTrue,True,12d,1\nfalse,,7F,2\n")
    df = load_csv(spark, str(p), "target")
    assert dict(df.dtypes) == {"flag": "boolean", "holes": "string", "code": "string", "target": "bigint"}
    assert [r["flag"] for r in df.orderBy("target").collect()] == [True, False]
