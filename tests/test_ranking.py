import numpy as np
import pytest
from pyspark.sql import functions as F

from featlens.operators.quantiles import quantiles
from featlens.operators.ranking import average_rank, ordered_cells, row_ids


def _avg_rank(values):
    v = np.asarray(values, dtype=float)
    order = np.argsort(v, kind="mergesort")
    ranks = np.empty(len(v))
    sv = v[order]
    i = 0
    while i < len(sv):
        j = i
        while j + 1 < len(sv) and sv[j + 1] == sv[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2.0 + 1
        i = j + 1
    return ranks


def test_average_rank_with_hot_value(spark):
    rng = np.random.default_rng(1)
    vals = list(rng.integers(0, 500, 3000).astype(float)) + [7.0] * 1500   # one value holds a third
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, v double")
    got = {r["id"]: r["rank"] for r in average_rank(df, "v", None, "rank", buckets=16).collect()}
    exp = _avg_rank(vals)
    assert all(abs(got[i] - exp[i]) < 1e-9 for i in range(len(vals)))


def test_grouped_cells_and_dense(spark):
    rows = [(g, float(v)) for g in ("a", "b") for v in [3, 1, 2, 2, 5, 1]]
    df = spark.createDataFrame(rows, "g string, v double")
    cells = {(r["g"], r["v"]): (r["cnt"], r["before"], r["dense_before"])
             for r in ordered_cells(df, "v", ["g"], buckets=4).collect()}
    assert cells[("a", 1.0)] == (2, 0, 0)
    assert cells[("a", 2.0)] == (2, 2, 1)
    assert cells[("b", 5.0)] == (1, 5, 3)


def test_row_ids_consecutive(spark):
    df = spark.createDataFrame([(k,) for k in [10, 3, 7, 100, 42]], "k long")
    got = sorted((r["k"], r["id"]) for r in row_ids(df, "k").collect())
    assert [i for _, i in got] == [0, 1, 2, 3, 4]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=997), [np.nan] * 0, [2.0] * 300])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = {r["q"]: r["value"] for r in quantiles(df, "v", probs).collect()}
    for q in probs:
        assert abs(got[q] - np.percentile(vals, q * 100)) < 1e-12


def test_multilevel_buckets_match_numpy(spark, monkeypatch):
    """Many cells per bucket -> extra levels of cuts; ranks and quantiles stay exact."""
    import featlens.operators.ranking as R
    monkeypatch.setattr(R, "CELLS_PER_BUCKET", 5)       # 4 buckets/level -> 3 levels for ~400 cells
    rng = np.random.default_rng(3)
    vals = list(rng.integers(0, 400, 1200).astype(float)) + [11.0] * 600
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, v double")
    got = {r["id"]: r["rank"] for r in average_rank(df, "v", None, "rank", buckets=4).collect()}
    exp = _avg_rank(vals)
    assert all(abs(got[i] - exp[i]) < 1e-9 for i in range(len(vals)))
    probs = [0.0, 0.33, 0.5, 0.9, 1.0]
    qs = {r["q"]: r["value"] for r in quantiles(df, "v", probs, buckets=4).collect()}
    for q in probs:
        assert abs(qs[q] - np.percentile(vals, q * 100)) < 1e-12


@pytest.mark.parametrize("bound", [60, 20])
def test_grouped_ranks_one_bucket_or_levels(spark, monkeypatch, bound):
    """Total cells over the bound: one bucket per group while each group fits (bound 60),
    levels of cuts once a group does not (bound 20); ranks stay exact per group."""
    import featlens.operators.ranking as R
    monkeypatch.setattr(R, "CELLS_PER_BUCKET", bound)
    rng = np.random.default_rng(5)
    data = {g: list(rng.integers(0, 50, 400).astype(float)) + [3.0] * 200 for g in ("a", "b", "c")}
    rows = [(g, i, float(v)) for g in data for i, v in enumerate(data[g])]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = {(r["g"], r["id"]): r["rank"] for r in average_rank(df, "v", "g", "rank", buckets=4).collect()}
    for g, vals in data.items():
        exp = _avg_rank(vals)
        assert all(abs(got[(g, i)] - exp[i]) < 1e-9 for i in range(len(vals)))


def test_bucket_levels_follow_cell_count(spark, monkeypatch):
    """One bucket while the largest group fits; then 4, 16, 64 ... ids per group, just enough
    that a bucket averages at most CELLS_PER_BUCKET cells; equal values share a bucket."""
    import featlens.operators.ranking as R
    from featlens.session import materialize
    cells = materialize(spark.range(401).select(F.col("id").cast("double").alias("v"),
                                                F.lit(1).cast("bigint").alias("cnt")))
    for bound, want in [(500, 1), (200, 4), (30, 16), (5, 256)]:
        monkeypatch.setattr(R, "CELLS_PER_BUCKET", bound)
        out, nb = R.bucketize(cells, "v", [], buckets=4)
        assert nb == want
        got = out.orderBy("v").select("_b").collect()
        ids = [r["_b"] for r in got]
        assert ids == sorted(ids) and 0 <= ids[0] and ids[-1] < nb
