"""Intermediate tables go when their block ends; equal plans are written once."""

import os

import pytest
from pyspark.sql import functions as F

from featlens.plans import load_all
from featlens.plans.registry import spark_queries, write_query
from featlens.session import ensure_checkpoint_dir, materialize, owned_tables
from tests.conftest import SF001


def tables(spark):
    return {x for x in os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")) if x.startswith("featlens-")}


def test_tables_go_and_equal_plans_are_written_once(spark):
    before = tables(spark)
    with owned_tables(spark):
        one = materialize(spark.range(10).select((F.col("id") * 2).alias("v")))
        same = materialize(spark.range(10).select((F.col("id") * 2).alias("v")))
        other = materialize(spark.range(10).select((F.col("id") * 3).alias("v")))
        assert len(tables(spark) - before) == 2
        assert one.union(same).count() == 20 and other.agg(F.max("v")).first()[0] == 27
    assert tables(spark) == before


def test_tables_go_after_an_error_and_kept_ones_stay(spark):
    before = tables(spark)
    with pytest.raises(ZeroDivisionError), owned_tables(spark) as outer:
        with owned_tables(spark) as inner:
            left = inner.keep(materialize(spark.range(5)).where("id > 2"))
            assert len(tables(spark) - before) == 2
        assert len(tables(spark) - before) == 1 and left.count() == 2
        final = outer.keep(left)
        1 / 0
    assert len(tables(spark) - before) == 1 and final.count() == 2   # kept by the outermost block: nobody's


@pytest.mark.parametrize("name", ["corr_pearson", "corr_report", "bin_quantile", "impute_median"])
def test_a_written_query_leaves_nothing_behind(spark, tmp_path, name):
    load_all()
    before = tables(spark)
    write_query(name, spark, SF001, str(tmp_path / name))
    assert tables(spark) == before
    got = spark.read.parquet(str(tmp_path / name))
    want = spark_queries()[name](spark, SF001)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()
