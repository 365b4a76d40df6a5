"""Rate analytics (J1, A1-A9, F5-F18, W3-W4) and source (S2-S4) queries.

Areas are parts (attributes from ``part``) and nations; rates are shares of returned
lineitems per part and of customers with a negative balance per nation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from featlens.functions import scalar as fn
from featlens.operators import rates as A
from featlens.operators.ranking import row_ids
from featlens.plans.registry import register
from featlens.sources import readers as S

PART_RATES_SQL = (
    "WITH r AS (SELECT l_partkey AS p_partkey, count(*) AS n_lines, "
    "count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, "
    "count(*) FILTER (WHERE l_returnflag = 'A') AS n_accepted FROM lineitem GROUP BY l_partkey), "
    "j AS (SELECT p.p_partkey, p.p_brand, p.p_size, p.p_retailprice, r.n_lines, r.n_returned, r.n_accepted, "
    "100 * (r.n_returned / r.n_lines) AS rate, 100 * (r.n_accepted / r.n_lines) AS moe "
    "FROM part p LEFT JOIN r ON p.p_partkey = r.p_partkey WHERE 100 * (r.n_returned / r.n_lines) IS NOT NULL)\n")


def part_rates(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    r = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_returned"),
        F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("n_accepted"))
    r = A.add_rates(r, {"rate": ("n_returned", "n_lines"), "moe": ("n_accepted", "n_lines")})
    areas = S.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return A.merge_rates(areas, r, "p_partkey", "rate")


@register("rate_join", sql=PART_RATES_SQL + "SELECT * FROM j", doubles=["p_retailprice", "rate", "moe"])
def rate_join(spark, sf_dir):
    return part_rates(spark, sf_dir)


@register("rate_stats",
          sql=PART_RATES_SQL + "SELECT avg(rate) AS mean_rate, max(rate) AS max_rate, min(rate) AS min_rate, "
                               "stddev_samp(rate) AS std_rate, count(*) AS n_areas, "
                               "CAST(coalesce(sum(n_returned), 0) AS BIGINT) AS total_n_returned, "
                               "CAST(coalesce(sum(n_lines), 0) AS BIGINT) AS total_n_lines, "
                               "quantile_cont(rate, 0.5) AS median_rate, "
                               "100.0 * sum(n_returned) / sum(n_lines) AS overall_rate, "
                               "avg(rate) AS mean_of_rates FROM j",
          doubles=["mean_rate", "max_rate", "min_rate", "std_rate", "median_rate", "overall_rate", "mean_of_rates"])
def rate_stats(spark, sf_dir):
    j = part_rates(spark, sf_dir)
    return A.rate_stats(j, "rate", ["n_returned", "n_lines"]).crossJoin(
        A.overall_rate(j, "n_returned", "n_lines", "rate"))


@register("rate_top15",
          sql=PART_RATES_SQL + "SELECT * FROM j ORDER BY rate DESC, p_partkey LIMIT 15",
          doubles=["p_retailprice", "rate", "moe"])
def rate_top15(spark, sf_dir):
    return A.top_n(part_rates(spark, sf_dir), "rate", "p_partkey", 15)


@register("rate_histogram",
          sql=PART_RATES_SQL + ", s AS (SELECT min(rate) AS lo, max(rate) AS hi FROM j), "
                               "b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(17, floor((rate - lo) / "
                               "((hi - lo) / 18))) AS INTEGER) END AS bin FROM j, s), "
                               "g AS (SELECT CAST(unnest(range(0, 18)) AS INTEGER) AS bin, lo, hi FROM s) "
                               "SELECT g.bin, lo + g.bin * (hi - lo) / 18 AS \"left\", lo + (g.bin + 1) * (hi - lo) / 18 "
                               "AS \"right\", CAST(count(b.bin) AS BIGINT) AS count FROM g LEFT JOIN b ON g.bin = b.bin "
                               "GROUP BY ALL",
          doubles=["left", "right"])
def rate_histogram(spark, sf_dir):
    return A.histogram(part_rates(spark, sf_dir), "rate", 18)


@register("rate_clip",
          sql=PART_RATES_SQL + "SELECT p_partkey, rate, greatest(0.0, least(rate, (SELECT quantile_cont(rate, 0.95) "
                               "FROM j))) AS rate_clipped FROM j",
          doubles=["rate", "rate_clipped"])
def rate_clip(spark, sf_dir):
    return A.clip_to_quantile(part_rates(spark, sf_dir), "rate", 0.95).select("p_partkey", "rate", "rate_clipped")


@register("rate_trend_grid",
          sql=PART_RATES_SQL + ", f AS (SELECT regr_slope(rate, p_retailprice) AS slope, "
                               "regr_intercept(rate, p_retailprice) AS intercept, min(p_retailprice) AS x_min, "
                               "max(p_retailprice) AS x_max FROM j), g AS (SELECT unnest(range(0, 100)) AS i, * FROM f) "
                               "SELECT CAST(i AS BIGINT) AS i, x_min + i * (x_max - x_min) / 99 AS x, "
                               "intercept + slope * (x_min + i * (x_max - x_min) / 99) AS y_fit FROM g",
          doubles=["x", "y_fit"])
def rate_trend_grid(spark, sf_dir):
    return A.fitted_grid(part_rates(spark, sf_dir), "p_retailprice", "rate", 100)


@register("rate_axis",
          sql=PART_RATES_SQL + "SELECT max(rate) * 1.15 AS axis_max, avg(rate) AS grand_mean FROM j",
          doubles=["axis_max", "grand_mean"])
def rate_axis(spark, sf_dir):
    j = part_rates(spark, sf_dir)
    return A.axis_max(j, "rate").crossJoin(A.grand_mean(j, "rate"))


NATION_SQL = (
    "WITH r AS (SELECT c_nationkey AS n_nationkey, count(*) AS n_customers, "
    "count(*) FILTER (WHERE c_acctbal < 0) AS n_negative FROM customer GROUP BY c_nationkey), "
    "a AS (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1), "
    "j AS (SELECT a.*, r.n_customers, r.n_negative, 100 * (r.n_negative / r.n_customers) AS rate "
    "FROM a LEFT JOIN r USING (n_nationkey) WHERE 100 * (r.n_negative / r.n_customers) IS NOT NULL)\n")


def nation_rates(spark, sf_dir, region: int = 1):
    cust = S.table(spark, sf_dir, "customer")
    r = cust.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("n_customers"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("n_negative"))
    r = A.add_rates(r, {"rate": ("n_negative", "n_customers")})
    areas = S.scan_attributes(S.table(spark, sf_dir, "nation"), "n_regionkey", region,
                              ["n_nationkey", "n_name", "n_regionkey"])
    return A.merge_rates(areas, r, "n_nationkey", "rate")


@register("nation_rates",
          sql=NATION_SQL + "SELECT n_nationkey, n_name, n_regionkey, n_customers, n_negative, rate, "
                           "CAST(n_regionkey AS VARCHAR) || '-' || CAST(n_nationkey AS VARCHAR) AS geo_key, "
                           "split_part(n_name, '_', 1) AS label, printf('%.1f', round_even(rate, 1)) || '%' AS rate_label, "
                           "printf('%+.4f', rate / 100) AS share_signed, substring(n_name, 1, 20) AS short_name FROM j",
          doubles=["rate"])
def nation_rates_q(spark, sf_dir):
    j = nation_rates(spark, sf_dir)
    return j.select("n_nationkey", "n_name", "n_regionkey", "n_customers", "n_negative", "rate",
                    fn.key_concat("n_regionkey", F.lit("-"), "n_nationkey").alias("geo_key"),
                    fn.first_part("n_name", "_").alias("label"),
                    fn.pct_label("rate").alias("rate_label"),
                    fn.signed(F.col("rate") / 100, 4).alias("share_signed"),
                    fn.short_name("n_name", 20).alias("short_name"))


@register("json_table",
          sql="SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
          doubles=["value"])
def json_table(spark, sf_dir):
    """S2 + F6: every event is landed as a JSON array-of-arrays document (header row first,
    all strings); the documents are exploded in parallel and the strings coerced back."""
    ev = S.table(spark, sf_dir, "events")
    docs = ev.select(F.to_json(F.array(
        F.array(F.lit("event_id"), F.lit("event_type"), F.lit("value"), F.lit("props")),
        F.array(F.col("event_id").cast("string"), "event_type", F.col("value").cast("string"), "props")))
        .alias("value"))
    rows = S.nested_json_rows(docs)
    return rows.select(fn.coerce_numeric("event_id").cast("bigint").alias("event_id"), "event_type",
                       fn.coerce_numeric("value").alias("value"),
                       F.from_json("props", "k bigint")["k"].alias("k"))


@register("coerce_numeric",
          sql="SELECT p_partkey, TRY_CAST(trim(split_part(p_brand, '#', 2)) AS DOUBLE) AS brand_no, "
              "TRY_CAST(trim(p_type) AS DOUBLE) AS type_num, TRY_CAST(trim(CAST(p_size AS VARCHAR)) AS DOUBLE) "
              "AS size_num FROM part",
          doubles=["brand_no", "type_num", "size_num"])
def coerce_numeric(spark, sf_dir):
    p = S.table(spark, sf_dir, "part")
    return p.select("p_partkey", fn.coerce_numeric(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("brand_no"),
                    fn.coerce_numeric("p_type").alias("type_num"),
                    fn.coerce_numeric(F.col("p_size").cast("string")).alias("size_num"))


@register("preview",
          sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10",
          doubles=["o_totalprice"])
def preview(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return S.preview(o, "o_orderkey", 10)


@register("row_ids",
          sql="SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS id "
              "FROM customer")
def row_ids_q(spark, sf_dir):
    c = S.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return row_ids(c, "c_custkey", "id", 0)
