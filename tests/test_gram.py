"""Cross-validation, regularisation paths and PCA on moment blocks, against plain numpy on the rows."""

import numpy as np
import pytest

from featlens.operators import gram
from featlens.operators.validate import cv_linear, fold_of


def table(spark, n=400):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=n), rng.exponential(size=n)
    rows = [(i, float(a[i]) + 1e6, float(b[i]), float(a[i] - 2 * b[i]), 7.0, float(3 * a[i] - b[i] + rng.normal())) for i in range(n)]
    rows[5] = (5, None, 1.0, 1.0, 7.0, 1.0)
    rows[6] = (6, 1.0, float("nan"), 1.0, 7.0, 1.0)
    df = spark.createDataFrame(rows, "k long, a double, `b.x` double, ab double, same double, y double").repartition(5)
    fold = {r.k: r.f for r in df.select("k", fold_of("k", 4).alias("f")).collect()}
    whole = np.array([[fold[r[0]], *r[1:]] for r in rows if r[0] not in (5, 6)], float)
    return df, whole[:, 0].astype(int), whole[:, 1:5], whole[:, 5]


FEATURES = ["a", "b.x", "ab", "same"]


def least(x, y, penalty, mix):
    """Penalised least squares on rows, by proximal gradient steps."""
    m, s = x.mean(axis=0), x.std(axis=0)
    z = (x - m) / np.where(s > 1e-9, s, np.inf)
    b = np.zeros(x.shape[1])
    step = 1 / (np.linalg.eigvalsh(z.T @ z / len(y)).max() + penalty)
    for _ in range(60_000):
        b = b - step * (z.T @ (z @ b - (y - y.mean())) / len(y) + penalty * (1 - mix) * b)
        b = np.sign(b) * np.maximum(0, np.abs(b) - step * penalty * mix)
    return lambda new: y.mean() + ((new - m) / np.where(s > 1e-9, s, np.inf)) @ b


@pytest.mark.parametrize("penalty,mix", [(0.0, 0.0), (0.2, 0.0), (0.2, 0.5), (0.4, 1.0), (50.0, 1.0)])
def test_cross_validation_equals_fits_on_rows(spark, penalty, mix):
    df, fold, x, y = table(spark)
    rows = gram.cross_validated(df, "k", "y", {"m": (FEATURES, penalty, mix), "one": (["b.x"], 0.0, 0.0)}, 4).collect()
    scores = []
    for f in range(4):
        predict = least(x[fold != f], y[fold != f], penalty, mix)
        rest = y[fold == f] - predict(x[fold == f])
        scores.append((1 - (rest ** 2).sum() / ((y[fold == f] - y[fold == f].mean()) ** 2).sum(), np.sqrt((rest ** 2).mean())))
        got = [r for r in rows if r.model == "m" and r.fold == f][0]
        assert (got.n_train, got.n_test) == ((fold != f).sum(), (fold == f).sum())
        assert np.allclose([got.r2, got.rmse], scores[-1], atol=1e-6)
    summary = {r.part: (r.r2, r.rmse) for r in rows if r.model == "m" and r.fold is None}
    assert np.allclose(summary["mean"], np.mean(scores, axis=0), atol=1e-6) and np.allclose(summary["std"], np.std(scores, axis=0), atol=1e-6)
    line = {r.fold: (r.r2, r.rmse) for r in rows if r.model == "one" and r.part == "fold"}
    both = df.where("a is not null and not isnan(`b.x`)").withColumnRenamed("b.x", "bx")
    assert all(np.allclose((r.r2, r.rmse), line[r.fold]) for r in cv_linear(both, "k", "bx", "y", 4).collect())


def test_path_ranks_the_grid(spark):
    df, *_ = table(spark)
    rows = gram.regularisation_path(df, "k", FEATURES, "y", (0.01, 5.0), (0.0, 1.0), 4).collect()
    assert [(r.penalty, r.mix) for r in rows] == [(0.01, 0.0), (0.01, 1.0), (5.0, 0.0), (5.0, 1.0)]
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4] and max(rows, key=lambda r: r.mean_r2)["rank"] == 1


def test_predictions_are_the_models(spark):
    df, _, x, y = table(spark)
    model = gram.elastic_net(gram.fold_moments(df, [*FEATURES, "y"])[0], FEATURES, "y", 0.3, 0.5)
    r2, rmse = model.errors(gram.fold_moments(df, [*FEATURES, "y"])[0], "y")
    got = df.select((df.y - model.predict()).alias("e")).where("e is not null and not isnan(e)").toPandas().e
    assert len(got) == len(y) and np.isclose(np.sqrt((got ** 2).mean()), rmse) and np.isclose(1 - (got ** 2).sum() / ((y - y.mean()) ** 2).sum(), r2)


@pytest.mark.parametrize("standardise", [True, False])
def test_pca_equals_numpy(spark, standardise):
    df, _, x, _ = table(spark)
    model = gram.pca(df, FEATURES, 3, standardise)
    z = x - x.mean(axis=0)
    z = z / np.where(z.std(axis=0) > 1e-9, z.std(axis=0), 1) if standardise else z
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(model.variances[:2], s[:2] ** 2 / len(z)) and abs(model.variances[2]) < 1e-6
    v = v[:2] * np.sign(v[:2][np.arange(2), np.abs(v[:2]).argmax(axis=1)])[:, None]
    assert np.allclose(model.loadings[:2], v, atol=1e-5)
    out = model.transform(df)
    assert out.columns == [*df.columns, "pc1", "pc2", "pc3"] and out.count() == df.count()
    got = out.where("a is not null and not isnan(`b.x`)").orderBy("k").toPandas()[["pc1", "pc2"]].to_numpy()
    assert np.allclose(got, z @ v.T, atol=1e-4)


def test_no_rows(spark):
    df, *_ = table(spark)
    none = df.where("false")
    assert gram.cross_validated(none, "k", "y", {"m": (FEATURES, 0.1, 0.5)}).count() == 0
    assert gram.regularisation_path(none, "k", FEATURES, "y").count() == 0
    assert gram.pca(none, FEATURES, 2).transform(none).count() == 0
