"""Feature selection through the correlation structure.

Everything here runs on feature-level tables (at most p or p^2 rows) derived from the long
matrix; joins against them are broadcast with a schema-derived size bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featlens.operators.assoc import target_correlations


def initialize_pool(corr: DataFrame, target: str, min_target_correlation: float = 0.10) -> DataFrame:
    """L1: ``(feature, pos, r, status)`` with status 'selected' if |r_t| >= min else 'pool'."""
    tv = target_correlations(corr, target)
    return tv.select("feature", "pos", "r", F.when(F.abs("r") >= min_target_correlation, "selected")
                     .otherwise("pool").alias("status"))


def find_correlated(corr: DataFrame, status: DataFrame, references: DataFrame,
                    min_correlation: float = 0.30) -> DataFrame:
    """L2-L3: for each pool feature, the reference with the largest |r| (first reference on
    ties, |r| must exceed 0); keep max >= min; score = max + 0.5 * |r_t|; score desc.

    ``references``: ``(feature, ref_order)``.
    """
    pool = status.filter(F.col("status") == "pool").select(F.col("feature").alias("f1"), "pos",
                                                           F.col("r").alias("target_correlation"))
    refs = references.select(F.col("feature").alias("f2"), "ref_order")
    m = corr.select("f1", "f2", F.abs("r").alias("abs_r"))
    links = pool.join(F.broadcast(refs), how="cross").join(m, ["f1", "f2"]).filter(F.col("abs_r") > 0)
    best = links.groupBy("f1", "pos", "target_correlation").agg(
        F.max_by("f2", F.struct("abs_r", -F.col("ref_order"))).alias("best_reference"),
        F.max("abs_r").alias("correlation_with_reference"))
    scored = (best.filter(F.col("correlation_with_reference") >= min_correlation)
              .withColumn("score", F.col("correlation_with_reference") + F.abs("target_correlation") * 0.5))
    w = Window.orderBy(F.col("score").desc(), "pos")
    return scored.select(F.col("f1").alias("feature"), "pos", "best_reference", "correlation_with_reference",
                         "target_correlation", "score",
                         F.row_number().over(w).cast("bigint").alias("rank"))


def promote(status: DataFrame, candidates: DataFrame, top_n: int = 3) -> DataFrame:
    """L4: the first ``top_n`` candidates move from 'pool' to 'reintroduced'."""
    top = candidates.filter(F.col("rank") <= top_n).select("feature", F.lit(True).alias("_promote"))
    return (status.join(F.broadcast(top), "feature", "left")
            .withColumn("status", F.when(F.col("_promote"), "reintroduced").otherwise(F.col("status")))
            .drop("_promote"))


def cross_term_pairs(status: DataFrame, n_top: int = 3) -> DataFrame:
    """The ``n_top`` strongest selected (non-reintroduced) features x every reintroduced
    feature, then pairs among those top features; ``(k, feature1, feature2)`` in creation order."""
    sel = status.filter(F.col("status") == "selected")
    top = sel.withColumn("_t", F.row_number().over(Window.orderBy(F.abs("r").desc_nulls_last(), "pos"))) \
        .filter(F.col("_t") <= n_top)
    re = status.filter(F.col("status") == "reintroduced").select(F.col("feature").alias("feature2"),
                                                                  F.col("pos").alias("_p2"))
    a = top.select(F.col("feature").alias("feature1"), F.col("_t").alias("_t1"))
    cross = a.crossJoin(re).select("feature1", "feature2", F.lit(0).alias("_grp"), "_t1",
                                   F.col("_p2").alias("_o2"))
    b = top.select(F.col("feature").alias("feature2"), F.col("_t").alias("_t2"))
    among = a.join(b, F.col("_t1") < F.col("_t2")).select("feature1", "feature2", F.lit(1).alias("_grp"),
                                                           "_t1", F.col("_t2").cast("bigint").alias("_o2"))
    both = cross.unionByName(among.withColumn("_o2", F.col("_o2").cast(cross.schema["_o2"].dataType)))
    w = Window.orderBy("_grp", "_t1", "_o2")
    return both.select(F.row_number().over(w).cast("bigint").alias("k"), "feature1", "feature2")


def status_summary(status: DataFrame) -> DataFrame:
    """Count and feature list per status (lists in column order)."""
    return status.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "feature"))),
                                 lambda s: s["feature"]), ",").alias("features"))


def membership_tag(df: DataFrame, status: DataFrame, key: str = "feature") -> DataFrame:
    """tag rows of a feature-level table with their status (left join)."""
    return df.join(F.broadcast(status.select(F.col("feature").alias(key), "status")), key, "left") \
        .withColumn("status", F.coalesce(F.col("status"), F.lit("other")))


def members(df: DataFrame, ids: DataFrame, key: str = "feature") -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (left semi join)."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def non_members(df: DataFrame, ids: DataFrame, key: str = "feature") -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids`` (left anti join)."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def valuable_features(created: DataFrame, importance: DataFrame, n: int = 5) -> DataFrame:
    """Created features that are among the top importances, creation order, first n."""
    top = importance.select("feature", "importance")
    return created.join(top, "feature", "inner").orderBy("k").limit(n)
