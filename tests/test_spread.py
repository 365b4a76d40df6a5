"""Few tasks that hold most rows are dealt out; the mart is joined once for queries that read it several times."""

import pytest
from pyspark.sql import functions as F

from featlens.operators import model as T
from featlens.plans import model_queries, moment_queries
from featlens.session import materialize, spread
from tests.conftest import SF001


def held(df):
    """Rows of the tasks that have any, the most first."""
    return sorted((r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()), reverse=True)


def reads(df, name):
    return any(name in f for f in df.inputFiles())


def test_rows_of_one_file_go_to_several_tasks(spark):
    one = materialize(spark.range(1000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b")).coalesce(1))
    assert len(held(one)) == 1
    out = spread(one, least=250)
    most = min(4, spark.sparkContext.defaultParallelism)
    assert len(held(out)) == most and max(held(out)) <= 1000 / most + 10
    assert sorted(map(str, out.collect())) == sorted(map(str, one.collect()))
    assert len(held(spread(one, least=500, most=10))) == 2          # never less than ``least`` rows a task


@pytest.mark.parametrize("rows, tasks", [(0, 1), (1000, 1), (1000, 4)])
def test_small_or_even_tables_stay(spark, rows, tasks):
    df = spark.range(0, rows, 1, tasks)
    assert spread(df, least=10_000 if tasks == 1 else 250) is df


def test_a_learner_gets_its_rows_in_several_tasks(spark):
    x = (F.col("id") % 11).cast("double")
    one = materialize(spark.range(250_000).select(x.alias("x"), (2 * x + 1).alias("y"), (F.col("id") % 5 == 0).alias("is_test")).coalesce(1))
    res = T.train_and_evaluate(one, ["x"], "y", "regression", "linear")
    counts = held(res.data)
    res.release()
    assert len(counts) == min(2, spark.sparkContext.defaultParallelism) and sum(counts) == 250_000


def test_the_mart_is_joined_once(spark, monkeypatch):
    assert not reads(moment_queries.filled_mart(spark, SF001), "lineitem")
    seen = {}

    def stop(df, *args, **kwargs):
        seen["df"] = df
        raise InterruptedError
    monkeypatch.setattr(T, "baseline_and_enhanced", stop)
    with pytest.raises(InterruptedError):
        model_queries.workflow(spark, SF001)
    assert not reads(seen["df"], "lineitem")
