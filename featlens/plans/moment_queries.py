"""Queries answered from fold moment blocks (D1, D2, D9-D11): one scan of the mart each.

The SQL sides solve the same problems on their own: normal equations by elimination, coordinate descent
as a recursion, principal components by repeated squaring of the correlation matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlens.operators import features as G, gram, validate as D
from featlens.operators.clean import impute
from featlens.plans.assoc_queries import mart_cte
from featlens.plans.mart import MART_FEATURES, TARGET, feature_mart, mart_table
from featlens.plans.registry import register

PRODUCT = "qty_X_size"


def filled_mart(spark, sf_dir):
    """The mart with its row key, gaps filled by the median."""
    return impute(mart_table(spark, sf_dir, with_key=True), "median", ["qty"])


def filled_cte(folds: int) -> str:
    filled = "coalesce(qty, (SELECT quantile_cont(qty, 0.5) FROM m))"
    return (mart_cte(with_key=True).rstrip() + f", d AS MATERIALIZED (SELECT m.* REPLACE ({filled} AS qty), {filled} * size AS \"{PRODUCT}\", "
            f"CAST(('0x' || substr(md5(CAST(rk AS VARCHAR) || '#42'), 1, 15))::BIGINT % {folds} AS INTEGER) AS fold FROM m)")


def train_cte(features: list[str], name: str) -> str:
    """Per fold: moments of the rows of the other folds."""
    pairs = [f'covar_pop("{a}", "{b}") AS c_{i}_{j}' for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    single = [f'avg("{a}") AS m_{i}, covar_pop("{a}", {TARGET}) AS g_{i}' for i, a in enumerate(features)]
    return (f"{name} AS MATERIALIZED (SELECT f.f, count(*) AS n, avg({TARGET}) AS my, {', '.join(single + pairs)} "
            "FROM (SELECT DISTINCT fold AS f FROM d) f JOIN d ON d.fold <> f.f GROUP BY f.f)")


def correlations(i: int, j: int) -> str:
    return f"c_{min(i, j)}_{max(i, j)} / sqrt(c_{i}_{i} * c_{j}_{j})"


def ridge_sql(features: list[str], penalty: float, name: str) -> tuple[str, str]:
    """(CTEs, SELECT of the fold scores) of ridge regression: elimination on the normal equations, column by column."""
    p = len(features)
    keep = ", ".join(["f", "n", "my"] + [f"m_{i}, s_{i}" for i in range(p)])
    cells = [(i, j) for i in range(p) for j in range(p + 1)]
    first = [f"sqrt(c_{i}_{i}) AS s_{i}" for i in range(p)]
    first += [f"{correlations(i, j)} + {penalty if i == j else 0.0} AS a_{i}_{j}" if j < p else f"g_{i} / sqrt(c_{i}_{i}) AS a_{i}_{p}" for i, j in cells]
    ctes = [train_cte(features, f"{name}_t"), f"{name}_0 AS MATERIALIZED (SELECT f, n, my, {', '.join(f'm_{i}' for i in range(p))}, {', '.join(first)} FROM {name}_t)"]
    for k in range(p):
        row = [f"a_{k}_{j} / a_{k}_{k} AS a_{k}_{j}" if i == k else f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}" for i, j in cells]
        ctes.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT {keep}, {', '.join(row)} FROM {name}_{k})")
    guess = " + ".join(["my"] + [f'a_{i}_{p} * ("{x}" - m_{i}) / s_{i}' for i, x in enumerate(features)])
    scored = (f"SELECT '{name}' AS model, fold, n AS n_train, count(*) AS n_test, 1 - sum(({TARGET} - e) ^ 2) / (var_pop({TARGET}) * count(*)) AS r2, "
              f"sqrt(avg(({TARGET} - e) ^ 2)) AS rmse FROM (SELECT d.fold, {TARGET}, n, {guess} AS e FROM d JOIN {name}_{p} ON f = d.fold) GROUP BY fold, n")
    return ", ".join(ctes), scored


def cv_sql(models: dict[str, tuple[list[str], float]]) -> str:
    parts = [ridge_sql(features, penalty, name) for name, (features, penalty) in models.items()]
    return (filled_cte(5) + ", " + ", ".join(c for c, _ in parts) + ", sc AS (" + " UNION ALL ".join(s for _, s in parts) + ") "
            "SELECT model, 'fold' AS part, fold, n_train, n_test, r2, rmse FROM sc "
            "UNION ALL SELECT model, 'mean', NULL, NULL, NULL, avg(r2), avg(rmse) FROM sc GROUP BY model "
            "UNION ALL SELECT model, 'std', NULL, NULL, NULL, stddev_pop(r2), stddev_pop(rmse) FROM sc GROUP BY model")


CV_MODELS = {"baseline": (MART_FEATURES, 0.01), "enhanced": (MART_FEATURES + [PRODUCT], 0.01)}


@register("cv_model", sql=cv_sql(CV_MODELS), doubles=["r2", "rmse"])
def cv_model(spark, sf_dir):
    """Baseline and enhanced ridge models on the same five folds: fold scores, mean and deviation."""
    m = G.create_interactions(filled_mart(spark, sf_dir), [("qty", "size")], "multiply", original=MART_FEATURES)
    return gram.cross_validated(m, "rk", TARGET, {name: (f, penalty, 0.0) for name, (f, penalty) in CV_MODELS.items()})


def paired_sql() -> str:
    parts = [ridge_sql([x], 0.0, x) for x in ("bal", "price")]
    t, wide = "mean_diff / (sd_diff / sqrt(k))", "(4 + t_stat * t_stat)"     # four degrees of freedom: the tail has a closed form
    return (filled_cte(5) + ", " + ", ".join(c for c, _ in parts) + f", a AS ({parts[0][1]}), b AS ({parts[1][1]}), "
            "st AS (SELECT count(*) AS k, avg(a.r2 - b.r2) AS mean_diff, stddev_samp(a.r2 - b.r2) AS sd_diff FROM a JOIN b ON a.fold = b.fold), "
            f"ts AS (SELECT *, {t} AS t_stat FROM st), "
            f"p AS (SELECT *, 1 - abs(t_stat) / sqrt({wide}) * (1 + 2 / {wide}) AS p_value FROM ts) SELECT *, p_value < 0.05 AS significant FROM p")


@register("paired_t", sql=paired_sql(), doubles=["mean_diff", "sd_diff", "t_stat", "p_value"])
def paired_t(spark, sf_dir):
    """Paired t-test on the fold scores of two one-predictor models, both from the same scan."""
    s = gram.cross_validated(feature_mart(spark, sf_dir, with_key=True), "rk", TARGET, {x: ([x], 0.0, 0.0) for x in ("bal", "price")}).where("part = 'fold'")
    s = s.groupBy("fold").pivot("model", ["bal", "price"]).agg(F.first("r2"))
    return D.paired_t(s, "price", "bal")


PENALTIES, MIXES = (0.1, 0.3, 1.0), (0.0, 0.5)


def path_sql(features: list[str], sweeps: int = 400) -> str:
    p = len(features)
    r = "[" + ", ".join("[" + ", ".join(correlations(i, j) for j in range(p)) + "]" for i in range(p)) + "]"
    g = "[" + ", ".join(f"g_{i} / sqrt(c_{i}_{i})" for i in range(p)) + "]"
    grid = ", ".join(f"({k}, {a}, {m})" for k, (a, m) in enumerate((a, m) for a in PENALTIES for m in MIXES))
    at, pull = f"t % {p} + 1", "(g[j] - list_dot_product(r[j], b) + b[j])"
    new = f"CASE WHEN i = j THEN sign({pull}) * greatest(0, abs({pull}) - l1) / (1 + l2) ELSE v END"
    guess = " + ".join(["my"] + [f'b[{i + 1}] * ("{x}" - m_{i}) / sqrt(c_{i}_{i})' for i, x in enumerate(features)])
    return (filled_cte(3).replace("WITH m AS", "WITH RECURSIVE m AS") + ", " + train_cte(features, "tr") + f", gr(k, penalty, mix) AS (VALUES {grid}), "
            f"e AS MATERIALIZED (SELECT f, k, penalty, mix, penalty * mix AS l1, penalty * (1 - mix) AS l2, {r} AS r, {g} AS g FROM tr, gr), "
            f"cd AS (SELECT f, k, 0 AS t, {at.replace('t %', '0 %')} AS j, l1, l2, r, g, list_transform(g, lambda x: CAST(0 AS DOUBLE)) AS b FROM e "
            f"UNION ALL SELECT f, k, t + 1, (t + 1) % {p} + 1, l1, l2, r, g, list_transform(b, lambda v, i: {new}) FROM cd WHERE t < {sweeps * p}), "
            f"w AS (SELECT f, k, b FROM cd WHERE t = {sweeps * p}), "
            f"sc AS (SELECT k, fold, 1 - sum(({TARGET} - y) ^ 2) / (var_pop({TARGET}) * count(*)) AS r2 "
            f"FROM (SELECT w.k, d.fold, {TARGET}, {guess} AS y FROM d JOIN w ON w.f = d.fold JOIN tr ON tr.f = d.fold) GROUP BY k, fold), "
            "av AS (SELECT k, avg(r2) AS mean_r2, stddev_pop(r2) AS std_r2 FROM sc GROUP BY k) "
            "SELECT CAST(penalty AS DOUBLE) AS penalty, CAST(mix AS DOUBLE) AS mix, mean_r2, std_r2, "
            "CAST(row_number() OVER (ORDER BY mean_r2 DESC, av.k) AS INTEGER) AS rank FROM av JOIN gr ON gr.k = av.k")


@register("grid_search", sql=path_sql(MART_FEATURES), doubles=["penalty", "mix", "mean_r2", "std_r2"])
def grid_search(spark, sf_dir):
    """Penalties and mixes of an elastic net on all features, gaps filled, scored on three folds."""
    return gram.regularisation_path(filled_mart(spark, sf_dir), "rk", MART_FEATURES, TARGET, PENALTIES, MIXES)


def pca_cte(cols: list[str], k: int, squarings: int = 12) -> str:
    """CTEs ``st`` (means, deviations) and ``v1, l1 ..`` (loadings ``(i, v)``, variances) of standardised columns."""
    st = ", ".join(f'avg("{c}") AS m_{i}, stddev_pop("{c}") AS s_{i}' for i, c in enumerate(cols))
    corr = ", ".join(f'corr("{a}", "{b}") AS c_{i}_{j}' for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j)
    cell = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {'CAST(1 AS DOUBLE)' if i == j else f'c_{min(i, j)}_{max(i, j)}'} AS v FROM st" for i in range(len(cols)) for j in range(len(cols)))
    out = [f"st AS MATERIALIZED (SELECT {st}, {corr} FROM d)", f"a1 AS MATERIALIZED ({cell})"]
    for c in range(1, k + 1):
        last = f"a{c}"
        for t in range(squarings):
            out.append(f"p{c}_{t} AS MATERIALIZED (SELECT x.i, y.j, sum(x.v * y.v) / (SELECT sum(v) ^ 2 FROM {last} WHERE i = j) AS v "
                       f"FROM {last} x JOIN {last} y ON x.j = y.i GROUP BY x.i, y.j)")
            last = f"p{c}_{t}"
        out.append(f"u{c} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {last} WHERE j = (SELECT j FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1))")
        out.append(f"v{c} AS MATERIALIZED (SELECT i, v * (SELECT sign(v) FROM u{c} WHERE abs(v) >= (SELECT max(abs(v)) FROM u{c}) - 1e-9 ORDER BY i LIMIT 1) AS v FROM u{c})")
        out.append(f"l{c} AS MATERIALIZED (SELECT sum(x.v * a.v * y.v) AS v FROM v{c} x JOIN a{c} a ON a.i = x.i JOIN v{c} y ON y.i = a.j)")
        out.append(f"a{c + 1} AS MATERIALIZED (SELECT a.i, a.j, a.v - (SELECT v FROM l{c}) * x.v * y.v AS v FROM a{c} a JOIN v{c} x ON x.i = a.i JOIN v{c} y ON y.i = a.j)")
    return ", ".join(out)


def pca_score_sql(k: int = 3) -> str:
    cols = MART_FEATURES
    each = [" + ".join(f'(SELECT v FROM v{c} WHERE i = {i}) * ("{x}" - m_{i}) / s_{i}' for i, x in enumerate(cols)) + f" AS pc{c}" for c in range(1, k + 1)]
    return filled_cte(5) + ", " + pca_cte(cols, k) + f" SELECT rk, {', '.join(each)} FROM d, st"


def pca_variance_sql(k: int = 3) -> str:
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(MART_FEATURES))
    each = " UNION ALL ".join(f"SELECT {c} AS component, l{c}.v AS variance, l{c}.v / {len(MART_FEATURES)} AS share, nm.name AS \"column\", v{c}.v AS loading "
                              f"FROM v{c} JOIN nm ON nm.i = v{c}.i, l{c}" for c in range(1, k + 1))
    return filled_cte(5) + ", " + pca_cte(MART_FEATURES, k) + f", nm(i, name) AS (VALUES {names}) {each}"


@register("pca_components", sql=pca_score_sql(), doubles=["pc1", "pc2", "pc3"])
def pca_components(spark, sf_dir):
    """Every row of the mart with its key and its first three principal components (standardised columns)."""
    m = filled_mart(spark, sf_dir)
    return gram.pca(m, MART_FEATURES, 3).transform(m).select("rk", "pc1", "pc2", "pc3")


@register("pca_variances", sql=pca_variance_sql(), doubles=["variance", "share", "loading"])
def pca_variances(spark, sf_dir):
    m = filled_mart(spark, sf_dir)
    return gram.pca(m, MART_FEATURES, 3).table(m)
