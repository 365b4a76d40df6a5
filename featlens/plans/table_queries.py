"""Queries that write files and read them back (S1, K1-K4, K6), and those of the small table operators
(P1, P9, F1-F4, F10, F13, C5, J5, G6, G18, T8, D7, A3 wide, A9 per row)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from featlens.operators import assoc, features as G, gram, model as T, profile, project, rates as A, select as L, validate as D
from featlens.plans.assoc_queries import TARGET_VEC_SQL, mart_corr, mart_cte, matrix_cte, q
from featlens.plans.feature_queries import _qlabel_sql
from featlens.plans.mart import MART_COLUMNS, MART_FEATURES, TARGET, feature_mart, mart_table
from featlens.plans.model_queries import _cv_sql
from featlens.plans.rate_queries import PART_RATES_SQL, part_rates
from featlens.plans.registry import register
from featlens.session import ensure_checkpoint_dir
from featlens.sources.readers import load_csv, table
from featlens.sources.sinks import feature_rows, write_csv, write_matrix_csv


def written(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("csv_round_trip",
          sql="SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, "
              "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment, "
              "CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 2 END AS gap, c_acctbal > 0 AS positive FROM customer",
          doubles=["c_acctbal"])
def csv_round_trip(spark, sf_dir):
    """Written as CSV with gaps, read again; types come from the text alone."""
    d = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") * 2).alias("gap"), (F.col("c_acctbal") > 0).alias("positive"))
    path = written(spark, "csv")
    write_csv(d, path)
    return load_csv(spark, path, "c_acctbal")


@register("matrix_csv", sql=matrix_cte() + "SELECT f1 AS feature, " + ", ".join(f"max(r) FILTER (WHERE f2 = '{c}') AS {q(c)}" for c in MART_COLUMNS) + " FROM c GROUP BY f1",
          doubles=MART_COLUMNS)
def matrix_csv(spark, sf_dir):
    """K1: the correlation matrix as a square CSV file, read again."""
    path = written(spark, "matrix")
    write_matrix_csv(mart_corr(spark, sf_dir), MART_COLUMNS, path)
    return load_csv(spark, path, "feature")


@register("geo_features",
          sql="SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_partkey, '{\"type\":\"Feature\",\"id\":' || (row_number() OVER (ORDER BY p_partkey) - 1) || "
              "',\"properties\":{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '},\"geometry\":\"POINT(' || p_partkey || ' ' || p_size || ')\"}' AS feature FROM part")
def geo_features(spark, sf_dir):
    """K6: one GeoJSON feature a row, numbered in key order."""
    d = table(spark, sf_dir, "part").withColumn("geometry", F.format_string("POINT(%d %d)", "p_partkey", "p_size"))
    return feature_rows(d, "p_partkey", "geometry", ["p_brand", "p_size"])


_DTYPES = "CASE column_type WHEN 'DOUBLE' THEN 'float64' WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'TIMESTAMP' THEN 'datetime64[us]' ELSE 'object' END"


@register("dtype_counts", sql=f"SELECT {_DTYPES} AS dtype, count(*) AS n_columns FROM (DESCRIBE SELECT * FROM lineitem) GROUP BY 1")
def dtype_counts(spark, sf_dir):
    return profile.dtype_counts(table(spark, sf_dir, "lineitem"))


@register("table_shape", sql="SELECT count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM lineitem)) AS n_cols FROM lineitem")
def table_shape(spark, sf_dir):
    return profile.shape(table(spark, sf_dir, "lineitem"))


@register("numeric_features",
          sql="WITH d AS (SELECT column_name AS feature, row_number() OVER () AS k FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')) "
              "SELECT feature, row_number() OVER (ORDER BY feature = 'l_extendedprice', k) - 1 AS pos FROM d")
def numeric_features(spark, sf_dir):
    """the numeric columns of a table, its target last."""
    names = assoc.numeric_features(table(spark, sf_dir, "lineitem"), "l_extendedprice", keep_target=True)
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, pos bigint")


@register("complete_rows", sql=mart_cte(with_key=True) + "SELECT rk, qty, price, target FROM m WHERE qty IS NOT NULL", doubles=["qty", "price", "target"])
def complete_rows(spark, sf_dir):
    """The wanted columns that exist, the target last, rows without gaps."""
    m = feature_mart(spark, sf_dir, with_key=True)
    names = project.available(m, ["rk", "qty", "no_such_column", "price"])
    return project.drop_missing(project.select_features(m, names, TARGET), names)


@register("constant_fill", sql=mart_cte(with_key=True) + "SELECT rk, coalesce(qty, -1) AS qty, size FROM m", doubles=["qty", "size"])
def constant_fill(spark, sf_dir):
    return project.fill_const(feature_mart(spark, sf_dir, with_key=True).select("rk", "qty", "size"), {"qty": -1.0})


@register("feature_membership",
          sql=matrix_cte() + f"SELECT feature, r, CASE WHEN abs(r) >= 0.25 THEN 'selected' ELSE 'other' END AS status, rank FROM ({TARGET_VEC_SQL}) WHERE rank <= 6", doubles=["r"])
def feature_membership(spark, sf_dir):
    """The six features nearest to the target, tagged with their status in the pool of the selected."""
    corr = mart_corr(spark, sf_dir)
    pool = L.initialize_pool(corr, TARGET, 0.25).where("status = 'selected'")
    top = assoc.top_k(assoc.target_correlations(corr, TARGET).select("feature", "r", "rank"), 6)
    return L.membership_tag(top, pool).select("feature", "r", "status", "rank")


@register("buyers", sql="SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer")
def buyers(spark, sf_dir):
    """Customers with orders and customers without."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return L.members(c, o, "c_custkey").withColumn("buys", F.lit(True)).unionByName(L.non_members(c, o, "c_custkey").withColumn("buys", F.lit(False)))


@register("created_features",
          sql="SELECT 10 AS original_features, 17 AS total_features, 7 AS created_features, 4 AS interaction_features, 3 AS polynomial_features, "
              "'qty_X_size,qty_PLUS_size,qty_DIV_size,qty_MINUS_size,qty_POW2,qty_POW3,price_POW2' AS feature_list, "
              "(SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) AS n_rows, sum(price_POW2) AS price_sum FROM ("
              + mart_cte() + "SELECT pow(price, 2) AS price_POW2 FROM m)", doubles=["price_sum"])
def created_features(spark, sf_dir):
    """A pair with an unknown column is left out, and the log tells what was made."""
    log = G.FeatureLog(list(MART_FEATURES))
    m = G.create_interactions(feature_mart(spark, sf_dir), [("qty", "size"), ("qty", "no_such_column")], "all", MART_FEATURES, log)
    m = G.create_polynomials(G.create_polynomials(m, ["qty", "no_such_column"], 3, MART_FEATURES, log), ["price"], 2, MART_FEATURES, log)
    told = G.feature_summary(spark, log).withColumn("feature_list", F.array_join("feature_list", ","))
    counts = m.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("price_POW2").alias("price_sum"))
    return told.select(*[F.col(c).cast("int") if c != "feature_list" else F.col(c) for c in told.columns]).crossJoin(counts)


@register("ols_fit",
          sql=mart_cte() + ", k AS (SELECT corr(bal, target) AS a, corr(ototal, target) AS b, corr(bal, ototal) AS c FROM m) "
              "SELECT 'bal' AS features, a * a AS r2 FROM k UNION ALL SELECT 'bal,ototal', (a * a + b * b - 2 * a * b * c) / (1 - c * c) FROM k", doubles=["r2"])
def ols_fit(spark, sf_dir):
    """In-sample R^2 of least squares."""
    m = feature_mart(spark, sf_dir)
    return spark.createDataFrame([(",".join(xs), T.ols_r2(m, xs, TARGET)) for xs in (["bal"], ["bal", "ototal"])], "features string, r2 double")


@register("complexity",
          sql=f"SELECT n_rows, train_r2, test_r2, 1 AS n_features, 1 < n_rows * 0.2 AS within_budget, n_rows > 20 AS enough_rows, train_r2 - test_r2 AS gap, "
              f"train_r2 - test_r2 > 0.2 AS overfit FROM (SELECT sum(n_test)::BIGINT AS n_rows, avg(r2) AS test_r2 FROM ({_cv_sql('bal')})) c, "
              f"({mart_cte()} SELECT corr(bal, target) ^ 2 AS train_r2 FROM m) t", doubles=["train_r2", "test_r2", "gap"])
def complexity(spark, sf_dir):
    """Feature budget, and the gap between the fit on all rows and the mean of the held-out folds."""
    blocks = gram.fold_moments(feature_mart(spark, sf_dir, with_key=True), ["bal", TARGET], D.fold_of("rk", 5), 5)
    whole = blocks[0]
    for b in blocks[1:]:
        whole = whole + b
    test = [r[5] for r in gram.cross_validate(blocks, TARGET, {"m": (["bal"], 0.0, 0.0)}) if r[1] == "mean"][0]
    train = gram.elastic_net(whole, ["bal"], TARGET).errors(whole, TARGET)[0]
    return D.complexity_check(spark.createDataFrame([(whole.n, train, test)], "n_rows bigint, train_r2 double, test_r2 double"), 1)


_LABELS = ["Low", "Med-Low", "Med-High", "High"]


@register("heatmap_wide",
          sql=mart_cte() + ", q AS (SELECT quantile_cont(bal, [0.25, 0.5, 0.75]) AS q_bal, quantile_cont(size, [0.25, 0.5, 0.75]) AS q_size FROM m), "
              f"b AS (SELECT {_qlabel_sql('bal')} AS bal_bin, {_qlabel_sql('size')} AS size_bin, target FROM m, q) "
              "SELECT bal_bin, " + ", ".join(f"avg(target) FILTER (WHERE size_bin = '{x}') AS {q(x)}" for x in _LABELS) + " FROM b GROUP BY bal_bin",
          doubles=_LABELS)
def heatmap_wide(spark, sf_dir):
    """A3: the grid of means in wide form."""
    b = G.quartile_labels(mart_table(spark, sf_dir), ["bal", "size"])
    return A.pivot_grid(A.group_mean_grid(b, "bal_bin", "size_bin", TARGET), "bal_bin", "size_bin", _LABELS)


@register("rate_fitted",
          sql=PART_RATES_SQL + ", f AS (SELECT regr_slope(rate, p_retailprice) AS slope, regr_intercept(rate, p_retailprice) AS intercept FROM j) "
              "SELECT p_partkey, rate, intercept + slope * p_retailprice AS y_fit FROM j, f", doubles=["rate", "y_fit"])
def rate_fitted(spark, sf_dir):
    """The trend line's value at every row."""
    return A.fitted_rows(part_rates(spark, sf_dir).select("p_partkey", "p_retailprice", "rate"), "p_retailprice", "rate").select("p_partkey", "rate", "y_fit")
