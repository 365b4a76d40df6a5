"""Association queries over the feature mart."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlens.operators import assoc
from featlens.plans.mart import MART_COLUMNS, TARGET, feature_mart, mart_sql
from featlens.plans.registry import register


def q(name: str) -> str:
    return f'"{name}"'


def mart_cte(null_every=7, with_key=False) -> str:
    return f"WITH m AS ({mart_sql(null_every, with_key)})\n"


def corr_sql(cols: list[str], source: str = "m") -> str:
    """Pairwise-complete Pearson in SQL: both orders + diagonal, NULL for constants."""
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = f"{q(a)} IS NOT NULL AND {q(b)} IS NOT NULL"
            parts.append(
                f"SELECT {i} AS i, {j} AS j, '{a}' AS f1, '{b}' AS f2, "
                f"CASE WHEN count(*) FILTER (WHERE {v}) >= 2 "
                f"AND max({q(a)}) FILTER (WHERE {v}) > min({q(a)}) FILTER (WHERE {v}) "
                f"AND max({q(b)}) FILTER (WHERE {v}) > min({q(b)}) FILTER (WHERE {v}) "
                f"THEN greatest(-1.0, least(1.0, corr({q(a)}, {q(b)}))) END::DOUBLE AS r, "
                f"count(*) FILTER (WHERE {v}) AS n FROM {source}")
    return "\nUNION ALL\n".join(parts)


def matrix_cte() -> str:
    return mart_cte() + f", c AS ({corr_sql(MART_COLUMNS)})\n"


def mart_corr(spark, sf_dir):
    return assoc.pearson_matrix(feature_mart(spark, sf_dir), MART_COLUMNS)


TARGET_VEC_SQL = ("SELECT f1 AS feature, i AS pos, r, "
                  "CAST(row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, i) AS BIGINT) AS rank "
                  f"FROM c WHERE f2 = '{TARGET}' AND f1 <> '{TARGET}'")


def suggest_sql(min_c: float, max_c: float, top_n: int) -> str:
    return (f"tv AS ({TARGET_VEC_SQL}), cand AS (SELECT a.feature AS feature1, b.feature AS feature2, "
            "a.rank AS rank1, b.rank AS rank2, a.r AS r1, b.r AS r2, c.r AS pair_r "
            f"FROM tv a JOIN tv b ON a.rank < b.rank JOIN c ON c.f1 = a.feature AND c.f2 = b.feature "
            f"WHERE abs(a.r) >= {min_c} AND abs(b.r) >= {min_c} AND abs(c.r) <= {max_c}), "
            f"sc AS (SELECT *, (abs(r1) + abs(r2)) * (1 - abs(pair_r) / {max_c}) AS score FROM cand), "
            "rk AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, rank1, rank2) AS BIGINT) AS rank FROM sc) "
            f"SELECT rank, feature1, feature2, score, r1, r2, pair_r FROM rk WHERE rank <= {top_n}")


@register("corr_pearson", sql=matrix_cte() + "SELECT i, j, f1, f2, r, n FROM c", doubles=["r"])
def corr_pearson(spark, sf_dir):
    return mart_corr(spark, sf_dir)


@register("target_corr", sql=matrix_cte() + TARGET_VEC_SQL, doubles=["r"])
def target_corr(spark, sf_dir):
    return assoc.target_correlations(mart_corr(spark, sf_dir), TARGET)


@register("multicollinear_pairs",
          sql=matrix_cte() + "SELECT f1 AS feature1, f2 AS feature2, r, i, j FROM c "
                             f"WHERE i < j AND f1 <> '{TARGET}' AND f2 <> '{TARGET}' AND abs(r) > 0.85",
          doubles=["r"])
def multicollinear_pairs(spark, sf_dir):
    return assoc.multicollinear_pairs(mart_corr(spark, sf_dir), TARGET, 0.85)


@register("suggest_pairs", sql=matrix_cte() + ", " + suggest_sql(0.15, 0.85, 20), doubles=["score", "r1", "r2", "pair_r"])
def suggest_pairs(spark, sf_dir):
    return assoc.suggest_pairs(mart_corr(spark, sf_dir), TARGET, 0.15, 0.85, 20)


@register("suggest_enriched", sql=matrix_cte() + ", " + suggest_sql(0.15, 0.80, 10),
          doubles=["score", "r1", "r2", "pair_r"])
def suggest_enriched(spark, sf_dir):
    corr = mart_corr(spark, sf_dir)
    pairs = assoc.suggest_pairs(corr, TARGET, 0.15, 0.80, 10)
    return assoc.enrich_pairs(pairs, corr, TARGET).select(
        "rank", "feature1", "feature2", "score", "r1", "r2", "pair_r")


@register("top_pairs",
          sql=matrix_cte() + "SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, i, j) "
                             "AS BIGINT) AS rank, f1 AS feature1, f2 AS feature2, r FROM c "
                             f"WHERE i < j AND f1 <> '{TARGET}' AND f2 <> '{TARGET}') WHERE rank <= 10",
          doubles=["r"])
def top_pairs(spark, sf_dir):
    return assoc.top_pairs(mart_corr(spark, sf_dir), TARGET, 10)


@register("lower_triangle", sql=matrix_cte() + "SELECT i, j, f1, f2, r, n FROM c WHERE i >= j AND i < 12 AND j < 12",
          doubles=["r"])
def lower_triangle(spark, sf_dir):
    return assoc.lower_triangle(mart_corr(spark, sf_dir), first=12)


@register("target_column",
          sql=matrix_cte() + "SELECT * FROM (SELECT f1 AS feature, i AS pos, r, CAST(row_number() OVER "
                             "(ORDER BY abs(r) DESC NULLS LAST, i) AS BIGINT) AS rank FROM c "
                             f"WHERE f2 = '{TARGET}') WHERE rank <= 15",
          doubles=["r"])
def target_column(spark, sf_dir):
    return assoc.target_column(mart_corr(spark, sf_dir), TARGET, 15)


@register("corr_report",
          sql=matrix_cte() + ", " + suggest_sql(0.15, 0.85, 20).replace("SELECT rank, feature1", ", sg AS (SELECT rank, feature1", 1)
          + ") SELECT (SELECT count(*) FROM tv) AS n_features, "
            "(SELECT string_agg(feature, ',' ORDER BY rank) FROM tv WHERE rank <= 10) AS top_features, "
            f"(SELECT count(*) FROM c WHERE i < j AND f1 <> '{TARGET}' AND f2 <> '{TARGET}' AND abs(r) > 0.85) "
            "AS n_multicollinear_pairs, (SELECT count(*) FROM sg) AS n_suggested_interactions, "
            f"'{TARGET}' AS target")
def corr_report(spark, sf_dir):
    rep = assoc.corr_report(mart_corr(spark, sf_dir), TARGET)
    return rep.select(
        "n_features",
        F.array_join(F.map_keys("top_correlations"), ",").alias("top_features"),
        "n_multicollinear_pairs", "n_suggested_interactions", "target")


@register("pair_corr",
          sql=mart_cte() + "SELECT count(*) AS n, corr(bal * size, target) AS r FROM m "
                           "WHERE bal IS NOT NULL AND size IS NOT NULL AND target IS NOT NULL",
          doubles=["r"])
def pair_corr(spark, sf_dir):
    m = feature_mart(spark, sf_dir)
    return assoc.pair_corr(m, F.col("bal") * F.col("size"), F.col("target"))


SPEARMAN_COLS = ["qty", "price", "size", "bal", "target"]


def spearman_sql(cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            sub = (f"SELECT rank() OVER (ORDER BY {q(a)}) + (count(*) OVER (PARTITION BY {q(a)}) - 1) / 2.0 AS rx, "
                   f"rank() OVER (ORDER BY {q(b)}) + (count(*) OVER (PARTITION BY {q(b)}) - 1) / 2.0 AS ry "
                   f"FROM m WHERE {q(a)} IS NOT NULL AND {q(b)} IS NOT NULL")
            parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS f1, '{b}' AS f2, "
                         "CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN greatest(-1.0, least(1.0, "
                         f"covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)))) END::DOUBLE AS r, "
                         f"count(*) AS n FROM ({sub})")
    return "\nUNION ALL\n".join(parts)


@register("corr_spearman", sql=mart_cte() + spearman_sql(SPEARMAN_COLS), doubles=["r"])
def corr_spearman(spark, sf_dir):
    return assoc.spearman_matrix(feature_mart(spark, sf_dir), SPEARMAN_COLS)


@register("corr_spearman_all", sql=mart_cte() + spearman_sql(MART_COLUMNS), doubles=["r"])
def corr_spearman_all(spark, sf_dir):
    """All eleven columns of the mart."""
    return assoc.spearman_matrix(feature_mart(spark, sf_dir), MART_COLUMNS)


#: Few values first: the column of a pair with fewer values is the one whose ranks are taken bit by bit.
KENDALL_ORDER = ["tax", "disc", "qty", "size", "load", "bal", "retail", "ototal", "price", "net", "target"]


def kendall_sql(cols: list[str], bits: int = 24) -> str:
    """tau-b from (x, y, weight) cells; discordant weight by the bits of y's dense rank."""
    cells, diag = [], []
    for i, a in enumerate(cols):
        diag.append(f"SELECT {i} AS i, {i} AS j, CASE WHEN max({q(a)}) > min({q(a)}) THEN 1.0 END AS r, count({q(a)}) AS n FROM m")
        for j, b in enumerate(cols[i + 1:], i + 1):
            y, x = sorted((a, b), key=KENDALL_ORDER.index)
            cells.append(f"SELECT {i} AS i, {j} AS j, {q(x)} AS x, {q(y)} AS y, count(*) AS w FROM m WHERE {q(a)} IS NOT NULL AND {q(b)} IS NOT NULL GROUP BY ALL")

    def tied(keys):
        return f"(SELECT i, j, sum(t * (t - 1) // 2) AS t FROM (SELECT i, j, CAST(sum(w) AS HUGEINT) AS t FROM ce GROUP BY i, j{keys}) GROUP BY i, j)"
    names = ", ".join(f"({k}, '{c}')" for k, c in enumerate(cols))
    return (f", ce AS MATERIALIZED ({' UNION ALL '.join(cells)}), "
            "ra AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY i, j ORDER BY y) - 1 AS k FROM ce), "
            "to_ AS (SELECT i, j, max(k) AS top FROM ra GROUP BY i, j), "
            f"bi AS (SELECT ra.i, ra.j, x, b, k >> (b + 1) AS g, sum(w * (k >> b & 1)) AS c1, sum(w * (1 - (k >> b & 1))) AS c0 "
            f"FROM ra JOIN to_ ON to_.i = ra.i AND to_.j = ra.j JOIN (SELECT unnest(range({bits})) AS b) ON top >> b > 0 GROUP BY ALL), "
            "di AS (SELECT i, j, sum(CAST(c0 AS HUGEINT) * h) AS d FROM (SELECT i, j, c0, sum(c1) OVER (PARTITION BY i, j, b, g ORDER BY x ROWS UNBOUNDED PRECEDING) - c1 AS h FROM bi) GROUP BY i, j), "
            f"st AS (SELECT n.i, n.j, n.n, n.t AS n0, a.t AS n1, b.t AS n2, c.t AS n3, coalesce(di.d, 0) AS d FROM (SELECT i, j, sum(w) AS n, CAST(sum(w) AS HUGEINT) * (sum(w) - 1) // 2 AS t FROM ce GROUP BY i, j) n "
            f"JOIN {tied(', x')} a ON a.i = n.i AND a.j = n.j JOIN {tied(', y')} b ON b.i = n.i AND b.j = n.j JOIN {tied(', x, y')} c ON c.i = n.i AND c.j = n.j "
            "LEFT JOIN di ON di.i = n.i AND di.j = n.j), "
            "up AS (SELECT i, j, CASE WHEN n0 > n1 AND n0 > n2 THEN CAST(n0 - n1 - n2 + n3 - 2 * d AS DOUBLE) / sqrt(CAST(n0 - n1 AS DOUBLE)) / sqrt(CAST(n0 - n2 AS DOUBLE)) END AS r, n FROM st), "
            f"nm(k, name) AS (VALUES {names}) "
            f"SELECT u.i, u.j, a.name AS f1, b.name AS f2, CAST(r AS DOUBLE) AS r, CAST(n AS BIGINT) AS n FROM (SELECT * FROM up UNION ALL SELECT j, i, r, n FROM up UNION ALL {' UNION ALL '.join(diag)}) u "
            "JOIN nm a ON a.k = u.i JOIN nm b ON b.k = u.j")


@register("corr_kendall", sql=mart_cte().rstrip() + kendall_sql(MART_COLUMNS), doubles=["r"])
def corr_kendall(spark, sf_dir):
    from featlens.operators.kendall import kendall_matrix
    return kendall_matrix(feature_mart(spark, sf_dir), MART_COLUMNS)
