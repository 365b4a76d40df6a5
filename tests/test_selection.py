"""Order statistics by bracket and count, and splits by one selected hash."""

import numpy as np
import pytest

from featlens.operators import model as T
from featlens.operators import selection
from featlens.operators.quantiles import quantile_long

PROBS = [0.0, 0.001, 0.25, 0.5, 0.9, 0.95, 1.0]


def columns(n=20_000):
    rng = np.random.default_rng(7)
    hot = np.where(rng.random(n) < 0.4, 3.0, rng.normal(size=n))
    gaps = np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n))
    wild = rng.normal(size=n)
    wild[:30], wild[30:50] = np.inf, -np.inf
    return {"hot": hot, "gaps": gaps, "wild": wild, "same": np.full(n, 5.0), "few": rng.integers(0, 3, n).astype(float)}


def expected(x, q):
    x = np.sort(x[~np.isnan(x)])
    at = q * (len(x) - 1)
    lo, hi = x[int(np.floor(at))], x[int(np.ceil(at))]
    return lo if lo == hi else lo + (at - np.floor(at)) * (hi - lo)


@pytest.mark.parametrize("margin", [selection.MARGIN, -300])    # brackets beside the wanted ranks: found by the second scan all the same
def test_quantiles_equal_numpy(spark, monkeypatch, margin):
    monkeypatch.setattr(selection, "MARGIN", margin)
    monkeypatch.setattr(selection, "KEPT", 500)
    data = columns()
    rows = [tuple(None if v != v and i % 2 else v for v in r) for i, r in enumerate(zip(*[x.tolist() for x in data.values()]))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).withColumnRenamed("hot", "a.hot").selectExpr("*", "cast(null as double) as none")
    got = {(c, q): v for c, q, v in selection.order_quantiles(df, df.columns, PROBS)}
    want = {("a.hot" if c == "hot" else c, q): expected(x, q) for c, x in data.items() for q in PROBS}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.isclose(got[k], v, rtol=0, atol=1e-12, equal_nan=True), k     # between -inf and a number there is none


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert quantile_long(df, ["a", "b"], [0.5]).collect() == []


def split_sizes(df, by=()):
    rows = df.groupBy(*by).agg({"is_test": "count"}).collect(), df.where("is_test").groupBy(*by).count().collect()
    return [{tuple(r)[:-1]: r[-1] for r in side} for side in rows]


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_exact_split_of_distinct_repeated_and_missing_keys(spark, n):
    rows = [(None if i % 3 == 0 else i % 11 if i % 5 == 0 else i, i if i % 2 else 4, "x") for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v int, _class string")
    out = T.exact_split(df, "k")
    assert out.columns == ["k", "v", "_class", "is_test"]
    assert out.count() == n and out.where("is_test").count() == -(-n // 5)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, out.select("k", "v", "_class").collect()), key=key) == sorted(rows, key=key)


@pytest.mark.parametrize("same_key", [False, True])
def test_stratified_split_sizes(spark, same_key):
    rows = [(1 if same_key else i, ["a", "b", None][i % 7 % 3], i // 2) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, y string, v int")
    every, test = split_sizes(T.stratified_split(df, "k", "y", 0.25), ["y"])
    assert sum(every.values()) == 500 and sum(test.values()) == 125
    assert all(abs(test[c] - every[c] / 4) < 1 for c in every)


def test_split_has_no_join_of_the_table_with_its_hashes(spark):
    df = spark.range(1000).toDF("k")
    plan = T.exact_split(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
