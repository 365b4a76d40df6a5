"""Feature engineering (G), selection (L) and pair-study (T18, A3, A8) queries on the mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlens.operators import assoc, features as G, rates as A, select as L
from featlens.operators.model import pair_study as _pair_study
from featlens.plans.assoc_queries import TARGET_VEC_SQL, matrix_cte, mart_corr, mart_cte
from featlens.plans.mart import MART_COLUMNS, TARGET, feature_mart, mart_table
from featlens.plans.registry import register

PAIRS = [("bal", "price"), ("qty", "net"), ("size", "disc")]
COLS = ", ".join(f'"{c}"' for c in MART_COLUMNS)


def _interaction_sql() -> str:
    new = []
    for a, b in PAIRS:
        new += [f'{a} * {b} AS "{a}_X_{b}"', f'{a} + {b} AS "{a}_PLUS_{b}"',
                f'coalesce({a} / NULLIF({b}, 0), (SELECT quantile_cont({a} / NULLIF({b}, 0), 0.5) FROM m)) '
                f'AS "{a}_DIV_{b}"', f'{a} - {b} AS "{a}_MINUS_{b}"']
    return mart_cte() + f"SELECT {COLS}, " + ", ".join(new) + " FROM m"


@register("interactions_all", sql=_interaction_sql(),
          doubles=MART_COLUMNS + [f"{a}_{k}_{b}" for a, b in PAIRS for k in ("X", "PLUS", "DIV", "MINUS")])
def interactions_all(spark, sf_dir):
    return G.create_interactions(feature_mart(spark, sf_dir), PAIRS, "all")


@register("polynomial",
          sql=mart_cte() + 'SELECT qty, size, pow(qty, 2) AS "qty_POW2", pow(qty, 3) AS "qty_POW3", '
                           'pow(size, 2) AS "size_POW2", pow(size, 3) AS "size_POW3" FROM m',
          doubles=["qty", "size", "qty_POW2", "qty_POW3", "size_POW2", "size_POW3"])
def polynomial(spark, sf_dir):
    return G.create_polynomials(feature_mart(spark, sf_dir), ["qty", "size"], 3).select(
        "qty", "size", "qty_POW2", "qty_POW3", "size_POW2", "size_POW3")


@register("log_shift",
          sql=mart_cte() + 'SELECT bal, price, ln(1 + CASE WHEN (SELECT min(bal) FROM m) <= 0 '
                           'THEN bal - (SELECT min(bal) FROM m) + 1 ELSE bal END) AS "bal_LOG", '
                           'ln(1 + CASE WHEN (SELECT min(price) FROM m) <= 0 THEN price - (SELECT min(price) FROM m) + 1 '
                           'ELSE price END) AS "price_LOG" FROM m',
          doubles=["bal", "price", "bal_LOG", "price_LOG"])
def log_shift(spark, sf_dir):
    return G.create_log_features(feature_mart(spark, sf_dir), ["bal", "price"], "shift").select(
        "bal", "price", "bal_LOG", "price_LOG")


@register("log_abs", sql=mart_cte() + 'SELECT bal, ln(1 + abs(bal)) AS "bal_LOG" FROM m',
          doubles=["bal", "bal_LOG"])
def log_abs(spark, sf_dir):
    return G.create_log_features(feature_mart(spark, sf_dir), ["bal"], "absolute").select("bal", "bal_LOG")


@register("log_skip", sql=mart_cte() + 'SELECT bal, price, ln(1 + price) AS "price_LOG" FROM m',
          doubles=["bal", "price", "price_LOG"])
def log_skip(spark, sf_dir):
    out = G.create_log_features(feature_mart(spark, sf_dir), ["bal", "price"], "skip")
    return out.select("bal", "price", *[c for c in out.columns if c.endswith("_LOG")])


def _bin_sql_quantile(cols: list[str], n: int) -> str:
    probs = ", ".join(str(k / n) for k in range(n + 1))
    edges = ", ".join(f"quantile_cont({c}, [{probs}]) AS e_{c}" for c in cols)
    bins = []
    for c in cols:
        terms = " + ".join(
            f"CASE WHEN e_{c}[{k + 1}] <= {c} AND e_{c}[{k + 1}] - e_{c}[{k}] > 1e-8 THEN 1 ELSE 0 END"
            for k in range(1, n))
        bins.append(f'CAST({terms} AS DOUBLE) AS "{c}_BIN{n}"')
    return mart_cte() + f", e AS (SELECT {edges} FROM m) SELECT {', '.join(cols)}, {', '.join(bins)} FROM m, e"


@register("bin_quantile", sql=_bin_sql_quantile(["price", "size", "bal"], 5),
          doubles=["price", "size", "bal", "price_BIN5", "size_BIN5", "bal_BIN5"])
def bin_quantile(spark, sf_dir):
    # qty holds NULLs, so it is skipped
    out = G.create_binned_features(mart_table(spark, sf_dir), ["price", "size", "bal", "qty"], 5, "quantile")
    return out.select("price", "size", "bal", *[c for c in out.columns if c.endswith("_BIN5")])


def _bin_sql_uniform(cols: list[str], n: int) -> str:
    st = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols)
    bins = []
    for c in cols:
        terms = " + ".join(f"CASE WHEN lo_{c} + (hi_{c} - lo_{c}) * {k} / {n} <= {c} THEN 1 ELSE 0 END"
                           for k in range(1, n))
        bins.append(f'CAST({terms} AS DOUBLE) AS "{c}_BIN{n}"')
    return mart_cte() + f", s AS (SELECT {st} FROM m) SELECT {', '.join(cols)}, {', '.join(bins)} FROM m, s"


@register("bin_uniform", sql=_bin_sql_uniform(["price", "size"], 5),
          doubles=["price", "size", "price_BIN5", "size_BIN5"])
def bin_uniform(spark, sf_dir):
    out = G.create_binned_features(feature_mart(spark, sf_dir), ["price", "size"], 5, "uniform")
    return out.select("price", "size", "price_BIN5", "size_BIN5")


def _bin_sql_kmeans(cols: list[str], n: int) -> str:
    """Lloyd's rounds as a recursion over (feature, centres); a value at a middle belongs to the lower centre."""
    cells = " UNION ALL ".join(f"SELECT {k} AS f, {c} AS v, count(*) AS w FROM m WHERE {c} IS NOT NULL GROUP BY {c}" for k, c in enumerate(cols))
    middles = "list_transform(range(1, len(c)), lambda i: (c[i] + c[i + 1]) / 2)"
    bins = ", ".join(f'CAST(len(list_filter((SELECT e FROM ed WHERE f = {k}), lambda x: x <= {c})) AS DOUBLE) AS "{c}_BIN{n}"' for k, c in enumerate(cols))
    return (mart_cte().rstrip().replace("WITH m AS", "WITH RECURSIVE m AS") + f", ce AS MATERIALIZED ({cells}), "
            "st AS (SELECT f, min(v) AS lo, max(v) AS hi, 1e-4 * (sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ^ 2) AS eps FROM ce GROUP BY f), "
            f"km AS (SELECT f, 0 AS t, list_transform(range({n}), lambda i: (lo + (hi - lo) * i / {n} + lo + (hi - lo) * (i + 1) / {n}) / 2) AS c, eps, CAST('inf' AS DOUBLE) AS shift FROM st "
            "UNION ALL SELECT f, t + 1, nc, eps, list_sum(list_transform(nc, lambda x, i: (x - c[i]) ^ 2)) FROM ("
            f"SELECT f, t, c, eps, list_transform(c, lambda x, i: coalesce(map_extract(mp, i - 1)[1], x)) AS nc FROM ("
            "SELECT f, t, c, eps, map_from_entries(list({'k': lab, 'v': mean})) AS mp FROM ("
            f"SELECT km.f, km.t, km.c, km.eps, len(list_filter({middles}, lambda y: y < v)) AS lab, sum(w * v) / sum(w) AS mean "
            "FROM km JOIN ce ON ce.f = km.f WHERE km.shift > km.eps AND km.t < 300 GROUP BY ALL) GROUP BY f, t, c, eps))), "
            f"ed AS (SELECT f, arg_max({middles}, t) AS e FROM km GROUP BY f) "
            f"SELECT {', '.join(cols)}, {bins} FROM m")


@register("bin_kmeans", sql=_bin_sql_kmeans(["size", "price"], 4), doubles=["size", "price", "size_BIN4", "price_BIN4"])
def bin_kmeans(spark, sf_dir):
    out = G.create_binned_features(mart_table(spark, sf_dir), ["size", "price"], 4, "kmeans")
    return out.select("size", "price", "size_BIN4", "price_BIN4")


@register("domain_cut",
          sql=mart_cte() + "SELECT size, price, CASE WHEN size > 0 AND size <= 10 THEN 'small' "
                           "WHEN size > 10 AND size <= 25 THEN 'medium' WHEN size > 25 AND size <= 50 THEN 'large' "
                           "END AS size_class, price / size AS price_per_size FROM m",
          doubles=["size", "price", "price_per_size"])
def domain_cut(spark, sf_dir):
    m = feature_mart(spark, sf_dir)
    out, failed = G.create_custom(m, {
        "size_class": lambda d: G.cut("size", [0, 10, 25, 50], ["small", "medium", "large"]),
        "price_per_size": lambda d: F.col("price") / F.col("size"),
        "broken": lambda d: F.col("no_such_column") * 2,          # reported and skipped
    })
    assert "broken" in failed
    return out.select("size", "price", "size_class", "price_per_size")


@register("low_variance",
          sql=mart_cte() + 'SELECT qty, price, size, retail, ototal, bal, net, "load", target FROM m',
          doubles=["qty", "price", "size", "retail", "ototal", "bal", "net", "load", "target"])
def low_variance(spark, sf_dir):
    return G.remove_low_variance(feature_mart(spark, sf_dir), TARGET, 0.01)


LABELS = ["Low", "Med-Low", "Med-High", "High"]


def _qlabel_sql(c: str) -> str:
    return (f"CASE WHEN {c} <= q_{c}[1] THEN 'Low' WHEN {c} <= q_{c}[2] THEN 'Med-Low' "
            f"WHEN {c} <= q_{c}[3] THEN 'Med-High' ELSE 'High' END")


@register("quartile_heatmap",
          sql=mart_cte() + ", q AS (SELECT quantile_cont(bal, [0.25, 0.5, 0.75]) AS q_bal, "
                           "quantile_cont(size, [0.25, 0.5, 0.75]) AS q_size FROM m) "
                           f"SELECT {_qlabel_sql('bal')} AS bal_bin, {_qlabel_sql('size')} AS size_bin, "
                           "avg(target) AS mean_value, count(*) AS n FROM m, q GROUP BY ALL",
          doubles=["mean_value"])
def quartile_heatmap(spark, sf_dir):
    m = mart_table(spark, sf_dir)
    b = G.quartile_labels(m, ["bal", "size"])
    return A.group_mean_grid(b, "bal_bin", "size_bin", TARGET)


@register("trend_line",
          sql=mart_cte() + "SELECT regr_slope(target, bal) AS slope, regr_intercept(target, bal) AS intercept, "
                           "min(bal) AS x_min, max(bal) AS x_max FROM m",
          doubles=["slope", "intercept", "x_min", "x_max"])
def trend_line(spark, sf_dir):
    return A.ols_line(feature_mart(spark, sf_dir), "bal", TARGET)


def _pair_study_sql(a: str, b: str, y: str) -> str:
    ab = f"{a} * {b}"
    cr = (f"corr({a}, {b}) AS r12, corr({a}, {ab}) AS r13, corr({b}, {ab}) AS r23, "
          f"corr({a}, {y}) AS r1y, corr({b}, {y}) AS r2y, corr({ab}, {y}) AS r3y")
    det = "(1 + 2*r12*r13*r23 - r12*r12 - r13*r13 - r23*r23)"
    quad = ("(r1y*r1y*(1 - r23*r23) + r2y*r2y*(1 - r13*r13) + r3y*r3y*(1 - r12*r12) "
            "+ 2*r1y*r2y*(r13*r23 - r12) + 2*r1y*r3y*(r12*r23 - r13) + 2*r2y*r3y*(r12*r13 - r23))")
    r2ab = "((r1y*r1y + r2y*r2y - 2*r1y*r2y*r12) / (1 - r12*r12))"
    return (mart_cte() + f", c AS (SELECT {cr} FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {y} IS NOT NULL), "
            f"r AS (SELECT r1y*r1y AS ra, r2y*r2y AS rb, {r2ab} AS rab, {quad} / {det} AS rabx FROM c) "
            f"SELECT '{a}' AS feature1, '{b}' AS feature2, ra AS r2_feature1, rb AS r2_feature2, rab AS r2_both, "
            "rabx AS r2_with_product, (rab - ra) / ra * 100 AS gain_vs_feature1_pct, "
            "(rabx - rab) / rab * 100 AS product_extra_pct FROM r")


@register("pair_study", sql=_pair_study_sql("bal", "size", "target"),
          doubles=["r2_feature1", "r2_feature2", "r2_both", "r2_with_product", "gain_vs_feature1_pct",
                   "product_extra_pct"])
def pair_study(spark, sf_dir):
    return _pair_study(feature_mart(spark, sf_dir), "bal", "size", TARGET)


# ---------------------------------------------------------------- selection (L)

POOL_MIN = 0.25
STATUS_SQL = (f"tv AS ({TARGET_VEC_SQL}), st AS (SELECT feature, pos, r, CASE WHEN abs(r) >= {POOL_MIN} "
              "THEN 'selected' ELSE 'pool' END AS status FROM tv)")
CAND_SQL = (STATUS_SQL + ", refs AS (SELECT feature AS ref, rank AS ref_order FROM tv WHERE rank <= 3), "
            "links AS (SELECT st.feature, st.pos, st.r AS target_correlation, refs.ref, refs.ref_order, "
            "abs(c.r) AS abs_r FROM st JOIN refs ON true JOIN c ON c.f1 = st.feature AND c.f2 = refs.ref "
            "WHERE st.status = 'pool' AND abs(c.r) > 0), "
            "best AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs_r DESC, ref_order) AS k "
            "FROM links), "
            f"cand AS (SELECT feature, pos, ref AS best_reference, abs_r AS correlation_with_reference, "
            f"target_correlation, abs_r + abs(target_correlation) * 0.5 AS score FROM best WHERE k = 1 "
            f"AND abs_r >= {POOL_MIN}), "
            "ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, pos) AS BIGINT) AS rank FROM cand)")
PROMOTED_SQL = (CAND_SQL + ", st2 AS (SELECT st.feature, st.pos, st.r, CASE WHEN ranked.rank <= 2 "
                "THEN 'reintroduced' ELSE st.status END AS status FROM st LEFT JOIN ranked USING (feature))")


def _status(spark, sf_dir):
    corr = mart_corr(spark, sf_dir)
    st = L.initialize_pool(corr, TARGET, POOL_MIN)
    refs = assoc.target_correlations(corr, TARGET).filter("rank <= 3").select(
        "feature", F.col("rank").alias("ref_order"))
    cand = L.find_correlated(corr, st, refs, POOL_MIN)
    return corr, st, cand, L.promote(st, cand, 2)


@register("feature_pool", sql=matrix_cte() + ", " + STATUS_SQL + " SELECT * FROM st", doubles=["r"])
def feature_pool(spark, sf_dir):
    return L.initialize_pool(mart_corr(spark, sf_dir), TARGET, POOL_MIN)


@register("reintroduce", sql=matrix_cte() + ", " + CAND_SQL + " SELECT * FROM ranked",
          doubles=["correlation_with_reference", "target_correlation", "score"])
def reintroduce(spark, sf_dir):
    return _status(spark, sf_dir)[2]


@register("status_summary",
          sql=matrix_cte() + ", " + PROMOTED_SQL + " SELECT status, count(*) AS n, "
              "string_agg(feature, ',' ORDER BY pos) AS features FROM st2 GROUP BY status")
def status_summary(spark, sf_dir):
    return L.status_summary(_status(spark, sf_dir)[3])


@register("cross_terms",
          sql=matrix_cte() + ", " + PROMOTED_SQL + ", top AS (SELECT feature, row_number() OVER "
              "(ORDER BY abs(r) DESC NULLS LAST, pos) AS t FROM st2 WHERE status = 'selected' QUALIFY t <= 3), "
              "re AS (SELECT feature, pos FROM st2 WHERE status = 'reintroduced'), "
              "u AS (SELECT top.feature AS feature1, re.feature AS feature2, 0 AS g, top.t AS t1, re.pos AS o2 "
              "FROM top, re UNION ALL SELECT a.feature, b.feature, 1, a.t, b.t FROM top a JOIN top b ON a.t < b.t) "
              "SELECT CAST(row_number() OVER (ORDER BY g, t1, o2) AS BIGINT) AS k, feature1, feature2 FROM u")
def cross_terms(spark, sf_dir):
    return L.cross_term_pairs(_status(spark, sf_dir)[3], 3)


@register("group_network",
          sql=matrix_cte() + ", " + PROMOTED_SQL + ", g AS (SELECT c.f1 AS \"left\", c.f2 AS \"right\", c.r, c.i, c.j "
              "FROM c JOIN st2 a ON a.feature = c.f1 AND a.status = 'reintroduced' "
              "JOIN st2 b ON b.feature = c.f2 AND b.status = 'selected' WHERE abs(c.r) > 0.3) "
              "SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, i, j) AS BIGINT) AS rank, "
              "\"left\", \"right\", r FROM g) WHERE rank <= 15",
          doubles=["r"])
def group_network(spark, sf_dir):
    corr, _, _, st = _status(spark, sf_dir)
    left = st.filter("status = 'reintroduced'").select("feature")
    right = st.filter("status = 'selected'").select("feature")
    return assoc.group_pairs_df(corr, left, right, 0.3, 15)
