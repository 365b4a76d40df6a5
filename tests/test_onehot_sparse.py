"""Sparse one-hot vectors against the columns that the dense form makes."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featlens.operators import clean

ROWS = [(1, "b", "x"), (2, "a", None), (3, None, "y"), (4, "c", "x"), (5, "b", "z"), (5, "b", "z")]


def test_sparse_vectors_equal_the_dense_columns(spark):
    df = spark.createDataFrame(ROWS, "k int, p string, q string")
    model = clean.fit_onehot_sparse(df)
    dense = clean.onehot(df)
    want = sorted((r[0], list(r[1:])) for r in dense.collect())
    names = dense.columns[1:]
    assert model.sizes == {"p": 3, "q": 3} and len(names) == 4
    got = []
    for r in model.transform(df).collect():
        v = [0.0] * r.onehot["size"]
        for i, x in zip(r.onehot["indices"], r.onehot["values"]):
            v[i] = x
        got.append((r.k, v))
    assert sorted(got) == want
    ml = model.vectors(df).select("k", vector_to_array("features"))
    assert sorted((r[0], list(r[1])) for r in ml.collect()) == want


def test_unknown_levels_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, "k int, p string, q string")
    model = clean.fit_onehot_sparse(df, ["p"])
    new = spark.createDataFrame([(9, "never seen", "x")], df.schema)
    row = model.transform(new).first()
    assert row.q == "x" and row.onehot == (2, [], [])
    none = clean.fit_onehot_sparse(df.where("false"), ["p"])
    assert none.sizes == {"p": 0} and none.transform(df).select(F.max("onehot.size")).first()[0] == 0
