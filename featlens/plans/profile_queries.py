"""Profiling (P), imputation (M) and encoding (E) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlens.operators import clean, profile
from featlens.plans.registry import register
from featlens.sources.readers import table

# Null injection (deterministic in both engines): user_id every 11th, event_type every
# 13th, value every 7th event.
EV_COLS = ["event_id", "user_id", "event_type", "value"]
EV_SQL = ("WITH ev AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id, "
          "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type, "
          "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)\n")


def events_with_nulls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        "event_id",
        F.when(eid % 11 == 0, F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(eid % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(eid % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"))


def _missing_sql() -> str:
    parts = []
    for c in EV_COLS:
        miss = f"{c} IS NULL" + (f" OR isnan({c})" if c == "value" else "")
        parts.append(f"SELECT '{c}' AS column, count(*) FILTER (WHERE {miss}) AS n_missing, "
                     f"count(*) FILTER (WHERE {miss}) * 100.0 / count(*) AS pct_missing FROM ev")
    return EV_SQL + "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_missing > 0"


@register("profile_missing", sql=_missing_sql(), doubles=["pct_missing"])
def profile_missing(spark, sf_dir):
    return profile.missing_report(events_with_nulls(spark, sf_dir))


@register("profile_info",
          sql=EV_SQL + "SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_cols, 'value' AS target, "
                       "CAST(count(*) FILTER (WHERE event_id IS NULL) + count(*) FILTER (WHERE user_id IS NULL) "
                       "+ count(*) FILTER (WHERE event_type IS NULL) "
                       "+ count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS BIGINT) AS missing_values, "
                       "CAST(3 AS BIGINT) AS numeric_features FROM ev")
def profile_info(spark, sf_dir):
    return profile.info(events_with_nulls(spark, sf_dir), "value")


@register("profile_target",
          sql="SELECT 'l_quantity' AS target, CASE WHEN count(DISTINCT l_quantity) < 20 THEN 'categorical' "
              "ELSE 'continuous' END AS kind, count(DISTINCT l_quantity) AS n_distinct, avg(l_quantity) AS mean, "
              "stddev_samp(l_quantity) AS std, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem",
          doubles=["mean", "std", "min", "max"])
def profile_target(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return profile.target_kind(li, "l_quantity").crossJoin(profile.target_stats(li, "l_quantity"))


DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql() -> str:
    parts = []
    for k, c in enumerate(DESCRIBE_COLS):
        parts.append(f"SELECT '{c}' AS column, {k} AS pos, count({c}) AS count, avg({c}) AS mean, "
                     f"stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS p25, "
                     f"quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max "
                     "FROM lineitem")
    return " UNION ALL ".join(parts)


@register("describe", sql=_describe_sql(), doubles=["mean", "std", "min", "p25", "p50", "p75", "max"])
def describe(spark, sf_dir):
    return profile.describe(table(spark, sf_dir, "lineitem"), DESCRIBE_COLS)


@register("class_distribution",
          sql=EV_SQL + "SELECT event_type AS value, count(*) AS count, "
                       "count(*) * 100.0 / (SELECT count(*) FROM ev) AS pct FROM ev "
                       "WHERE event_type IS NOT NULL GROUP BY event_type",
          doubles=["pct"])
def class_distribution(spark, sf_dir):
    return profile.class_distribution(events_with_nulls(spark, sf_dir), "event_type")


@register("task_type",
          sql="SELECT 'l_quantity' AS target, count(DISTINCT l_quantity) AS n_distinct, "
              "CASE WHEN count(DISTINCT l_quantity) > 20 THEN 'regression' ELSE 'classification' END AS task_type "
              "FROM lineitem UNION ALL "
              "SELECT 'l_linenumber', count(DISTINCT l_linenumber), CASE WHEN count(DISTINCT l_linenumber) > 20 "
              "THEN 'regression' ELSE 'classification' END FROM lineitem")
def task_type(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return profile.task_type(li, "l_quantity").unionByName(profile.task_type(li, "l_linenumber"))


# ---------------------------------------------------------------- imputation

@register("impute_mean",
          sql=EV_SQL + "SELECT event_id, coalesce(CAST(user_id AS DOUBLE), (SELECT avg(user_id) FROM ev)) AS user_id, "
                       "event_type, coalesce(value, (SELECT avg(value) FROM ev)) AS value FROM ev",
          doubles=["user_id", "value"])
def impute_mean(spark, sf_dir):
    return clean.impute(events_with_nulls(spark, sf_dir), "mean", ["user_id", "value"])


@register("impute_median",
          sql=EV_SQL + "SELECT event_id, coalesce(CAST(user_id AS DOUBLE), "
                       "(SELECT quantile_cont(user_id, 0.5) FROM ev)) AS user_id, event_type, "
                       "coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ev)) AS value FROM ev",
          doubles=["user_id", "value"])
def impute_median(spark, sf_dir):
    return clean.impute(events_with_nulls(spark, sf_dir), "median", ["user_id", "value"])


def _mode(c: str) -> str:
    return (f"(SELECT {c} FROM ev WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)")


@register("impute_mode",
          sql=EV_SQL + f"SELECT event_id, coalesce(user_id, {_mode('user_id')}) AS user_id, "
                       f"coalesce(event_type, {_mode('event_type')}) AS event_type, "
                       f"coalesce(value, {_mode('value')}) AS value FROM ev",
          doubles=["value"])
def impute_mode(spark, sf_dir):
    return clean.impute(events_with_nulls(spark, sf_dir), "mode", ["user_id", "event_type", "value"])


@register("impute_drop",
          sql=EV_SQL + "SELECT * FROM ev WHERE value IS NOT NULL AND NOT isnan(value) AND event_type IS NOT NULL",
          doubles=["value"])
def impute_drop(spark, sf_dir):
    return clean.impute(events_with_nulls(spark, sf_dir), "drop", ["value", "event_type"])


@register("impute_audit",
          sql=EV_SQL + "SELECT * FROM (SELECT 0 AS pos, 'value' AS column, count(*) FILTER (WHERE value IS NULL) AS n_imputed FROM ev "
                       "UNION ALL SELECT 1, 'event_type', count(*) FILTER (WHERE event_type IS NULL AND value IS NOT NULL) FROM ev "
                       "UNION ALL SELECT 2, 'user_id', count(*) FILTER (WHERE user_id IS NULL AND value IS NOT NULL "
                       "AND event_type IS NOT NULL) FROM ev) WHERE n_imputed > 0")
def impute_audit(spark, sf_dir):
    return clean.impute_audit(events_with_nulls(spark, sf_dir), "drop", ["value", "event_type", "user_id"])


@register("impute_auto",
          sql=EV_SQL + "SELECT event_id, coalesce(CAST(user_id AS DOUBLE), "
                       "(SELECT quantile_cont(user_id, 0.5) FROM ev)) AS user_id, event_type, "
                       "coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ev)) AS value "
                       "FROM ev", doubles=["user_id", "value"])
def impute_auto(spark, sf_dir):
    """M5: columns auto-selected (all with a missing value); the string column is then
    left to the categorical path, as median needs numbers."""
    ev = events_with_nulls(spark, sf_dir)
    cols = [c for c in clean.columns_with_missing(ev) if c != "event_type"]
    return clean.impute(ev, "median", cols)


# ---------------------------------------------------------------- encoding

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("onehot",
          sql="SELECT c_custkey, c_name, c_nationkey, c_acctbal, " + ", ".join(
              f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS c_mktsegment_{s}" for s in SEGMENTS[1:])
              + " FROM customer",
          doubles=["c_acctbal"] + [f"c_mktsegment_{s}" for s in SEGMENTS[1:]])
def onehot(spark, sf_dir):
    return clean.onehot(table(spark, sf_dir, "customer"), ["c_mktsegment"])


@register("onehot_sparse",
          sql="WITH c AS (SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS a, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS b FROM customer), "
              "n AS (SELECT max(a) AS na, max(b) AS nb FROM c) SELECT c_custkey, CAST(na + nb AS INTEGER) AS size, "
              "CAST(CASE WHEN a > 0 THEN a - 1 END AS INTEGER) AS name_at, CAST(CASE WHEN b > 0 THEN na + b - 1 END AS INTEGER) AS segment_at FROM c, n")
def onehot_sparse(spark, sf_dir):
    """E1 with a level for every customer: one sparse vector of both columns."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    model = clean.fit_onehot_sparse(c, ["c_name", "c_mktsegment"])
    names = model.sizes["c_name"] - 1
    v = model.transform(c).select("c_custkey", F.col("onehot.size").alias("size"), F.col("onehot.indices").alias("at"))
    first = F.filter("at", lambda x: x < names)
    last = F.filter("at", lambda x: x >= names)
    return v.select("c_custkey", "size", F.get(first, 0).alias("name_at"), F.get(last, 0).alias("segment_at"))


@register("label_encode",
          sql=EV_SQL + "SELECT event_id, user_id, CAST(dense_rank() OVER (ORDER BY coalesce(event_type, 'nan')) - 1 "
                       "AS BIGINT) AS event_type, value FROM ev",
          doubles=["value"])
def label_encode(spark, sf_dir):
    return clean.label_encode(events_with_nulls(spark, sf_dir), ["event_type"])
