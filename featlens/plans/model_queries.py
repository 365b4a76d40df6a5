"""Modelling (T), validation (D) queries: exact splits, scaling, metrics, comparisons,
cross-validation, pair rules and MLlib training (rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlens.functions.scalar import recommendation_band, strength_band
from featlens.operators import assoc, model as T, select as L, validate as D
from featlens.operators import features as G
from featlens.plans.assoc_queries import TARGET_VEC_SQL, matrix_cte, mart_corr, mart_cte
from featlens.plans.mart import MART_COLUMNS, MART_FEATURES, TARGET, feature_mart, mart_table
from featlens.plans.registry import register
from featlens.sources.readers import table

H = "('0x' || substr(md5(CAST({k} AS VARCHAR) || '#42'), 1, 15))::BIGINT"


@register("split_exact",
          sql="SELECT event_id, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || '#42'), event_id) "
              "<= ceil(CAST(count(*) OVER () AS DOUBLE) * 0.2) AS is_test FROM events")
def split_exact(spark, sf_dir):
    return T.exact_split(table(spark, sf_dir, "events").select("event_id"), "event_id", 0.2, 42)


@register("split_stratified",
          sql="WITH d AS (SELECT l.doc_id, l.quality, md5(CAST(l.doc_id AS VARCHAR) || '#42') AS h "
              "FROM labels l JOIN documents d USING (doc_id)), "
              "c AS (SELECT quality, count(*) AS nc FROM d GROUP BY quality), "
              "t AS (SELECT CAST(sum(nc) AS DOUBLE) AS n, ceil(CAST(sum(nc) AS DOUBLE) * 0.2) AS k FROM c), "
              "q AS (SELECT quality, nc * k / n AS ex, floor(nc * k / n) AS base, k FROM c, t), "
              "q2 AS (SELECT quality, base + CASE WHEN row_number() OVER (ORDER BY ex - base DESC, quality) "
              "<= k - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q) "
              "SELECT d.doc_id, d.quality, row_number() OVER (PARTITION BY d.quality ORDER BY h, d.doc_id) "
              "<= quota AS is_test FROM d JOIN q2 USING (quality)")
def split_stratified(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return T.stratified_split(lab.join(docs, "doc_id"), "doc_id", "quality", 0.2, 42).select(
        "doc_id", "quality", "is_test")


SPLIT_EV = ("WITH s AS (SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, value, row_number() OVER "
            "(ORDER BY md5(CAST(event_id AS VARCHAR) || '#42'), event_id) <= ceil(CAST(count(*) OVER () AS DOUBLE) "
            "* 0.2) AS is_test FROM events), "
            "st AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(user_id) AS mu, stddev_pop(user_id) AS su "
            "FROM s WHERE NOT is_test)\n")


@register("standardize",
          sql=SPLIT_EV + "SELECT event_id, is_test, CASE WHEN sv > 0 THEN (value - mv) / sv ELSE value - mv END "
                         "AS value, CASE WHEN su > 0 THEN (user_id - mu) / su ELSE user_id - mu END AS user_id "
                         "FROM s, st",
          doubles=["value", "user_id"])
def standardize(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("double").alias("user_id"), "value")
    split = T.exact_split(ev, "event_id")
    scaler = T.fit_scaler(split.filter(~F.col("is_test")), ["value", "user_id"])
    return scaler.transform(split).select("event_id", "is_test", "value", "user_id")


SCORED = ("{cte}, sc AS (SELECT target AS label, 0.6 * price + qty - 1.5 * size AS p_base, "
          "0.6 * price + qty - 1.5 * size + 0.02 * qty * size AS p_enh FROM m WHERE qty IS NOT NULL)\n")


def _scored(spark, sf_dir):
    m = feature_mart(spark, sf_dir).dropna(subset=["qty"])
    base = 0.6 * F.col("price") + F.col("qty") - 1.5 * F.col("size")
    return m.select(F.col(TARGET).alias("label"), base.alias("p_base"),
                    (base + 0.02 * F.col("qty") * F.col("size")).alias("p_enh"))


def _reg_sql(p: str) -> str:
    return (f"SELECT 1 - sum((label - {p}) * (label - {p})) / (var_pop(label) * count(*)) AS r2, "
            f"sqrt(sum((label - {p}) * (label - {p})) / count(*)) AS rmse, avg(abs(label - {p})) AS mae FROM sc")


@register("metrics_regression", sql=SCORED.format(cte=mart_cte().rstrip()) + _reg_sql("p_base"),
          doubles=["r2", "rmse", "mae"])
def metrics_regression(spark, sf_dir):
    return T.regression_metrics(_scored(spark, sf_dir), "label", "p_base")


CLS = ("WITH d AS (SELECT l.quality AS label, CASE WHEN d.n_chars > 3000 THEN 1 ELSE 0 END AS prediction, "
       "d.n_chars AS score FROM labels l JOIN documents d USING (doc_id))\n")


def _cls(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"))
    return lab.join(docs, "doc_id").withColumn("prediction", F.when(F.col("score") > 3000, 1).otherwise(0))


@register("metrics_classification",
          sql=CLS + ", cm AS (SELECT label AS y, prediction AS p, count(*) AS c FROM d GROUP BY ALL), "
                    "k AS (SELECT y AS k FROM cm UNION SELECT p FROM cm), "
                    "per AS (SELECT k.k, coalesce((SELECT sum(c) FROM cm WHERE y = k.k AND p = k.k), 0) AS tp, "
                    "coalesce((SELECT sum(c) FROM cm WHERE y = k.k), 0) AS support, "
                    "coalesce((SELECT sum(c) FROM cm WHERE p = k.k), 0) AS pred_pos FROM k), "
                    "per2 AS (SELECT *, CASE WHEN pred_pos > 0 THEN tp / pred_pos ELSE 0 END AS prec, "
                    "CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM per), "
                    "per3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 "
                    "FROM per2) SELECT sum(tp) / sum(support) AS accuracy, sum(prec * support) / sum(support) "
                    "AS precision, sum(rec * support) / sum(support) AS recall, sum(f1 * support) / sum(support) "
                    "AS f1 FROM per3",
          doubles=["accuracy", "precision", "recall", "f1"])
def metrics_classification(spark, sf_dir):
    return T.classification_metrics(_cls(spark, sf_dir), "label", "prediction")


@register("roc_auc",
          sql=CLS + ", r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) "
                    "/ 2.0 AS rk FROM d), s AS (SELECT count(DISTINCT label) AS nc, max(label) AS pos FROM d) "
                    "SELECT CASE WHEN nc = 2 THEN (sum(rk) FILTER (WHERE label = pos) - count(*) FILTER "
                    "(WHERE label = pos) * (count(*) FILTER (WHERE label = pos) + 1) / 2.0) / (count(*) FILTER "
                    "(WHERE label = pos) * count(*) FILTER (WHERE label <> pos)) END AS roc_auc FROM r, s GROUP BY nc",
          doubles=["roc_auc"])
def roc_auc(spark, sf_dir):
    return T.roc_auc(_cls(spark, sf_dir), "label", "score")


@register("confusion",
          sql=CLS + "SELECT label, prediction, count(*) AS count FROM d GROUP BY ALL")
def confusion(spark, sf_dir):
    return T.confusion(_cls(spark, sf_dir), "label", "prediction")


COMPARE_SQL = (SCORED.format(cte=mart_cte().rstrip())
               + ", b AS (" + _reg_sql("p_base").replace("AS r2", "AS baseline_r2").replace("AS rmse", "AS baseline_rmse")
               .replace("AS mae", "AS baseline_mae") + "), e AS ("
               + _reg_sql("p_enh").replace("AS r2", "AS enhanced_r2").replace("AS rmse", "AS enhanced_rmse")
               .replace("AS mae", "AS enhanced_mae") + ")\n")


@register("compare_models",
          sql=COMPARE_SQL + ", x AS (SELECT *, 'r2' AS metric, CASE WHEN baseline_r2 = 0 THEN NULL ELSE "
                            "(enhanced_r2 - baseline_r2) / baseline_r2 * 100 END AS improvement_pct FROM b, e) "
                            "SELECT *, CASE WHEN improvement_pct > 0 THEN 'improved' WHEN improvement_pct < -1 "
                            "THEN 'degraded' ELSE 'similar' END AS verdict, CASE WHEN improvement_pct > 5 THEN 'strong' "
                            "WHEN improvement_pct > 1 THEN 'moderate' WHEN improvement_pct > -1 THEN 'minimal' "
                            "WHEN improvement_pct IS NOT NULL THEN 'degradation' END AS recommendation FROM x",
          doubles=["baseline_r2", "baseline_rmse", "baseline_mae", "enhanced_r2", "enhanced_rmse", "enhanced_mae",
                   "improvement_pct"])
def compare_models(spark, sf_dir):
    s = _scored(spark, sf_dir)
    cmp = T.compare_models(*T.regression_metrics_of(s, "label", ["p_base", "p_enh"]))
    return cmp.withColumn("recommendation", recommendation_band("improvement_pct"))


@register("metric_delta",
          sql=COMPARE_SQL + "SELECT * FROM (SELECT 'r2' AS metric, baseline_r2 AS baseline, enhanced_r2 AS enhanced, "
                            "enhanced_r2 - baseline_r2 AS delta FROM b, e UNION ALL SELECT 'rmse', baseline_rmse, "
                            "enhanced_rmse, enhanced_rmse - baseline_rmse FROM b, e UNION ALL SELECT 'mae', "
                            "baseline_mae, enhanced_mae, enhanced_mae - baseline_mae FROM b, e)",
          doubles=["baseline", "enhanced", "delta"])
def metric_delta(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return T.metric_delta(*T.regression_metrics_of(s, "label", ["p_base", "p_enh"]))


def _cv_sql(x: str) -> str:
    fold = H.format(k="rk")
    return (mart_cte(with_key=True).rstrip() +
            f", d AS (SELECT CAST({fold} % 5 AS INTEGER) AS fold, {x} AS x, target AS y FROM m "
            f"WHERE {x} IS NOT NULL AND target IS NOT NULL), "
            "st AS (SELECT fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy "
            "FROM d GROUP BY fold), "
            "t AS (SELECT sum(n) AS tn, sum(sx) AS tsx, sum(sy) AS tsy, sum(sxx) AS tsxx, sum(sxy) AS tsxy FROM st), "
            "tr AS (SELECT fold, tn - n AS n, tsx - sx AS sx, tsy - sy AS sy, tsxx - sxx AS sxx, tsxy - sxy AS sxy "
            "FROM st, t), "
            "p AS (SELECT fold, n AS n_train, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, sx, sy, n FROM tr), "
            "p2 AS (SELECT fold, n_train, slope, (sy - slope * sx) / n AS intercept FROM p) "
            "SELECT d.fold, CAST(n_train AS BIGINT) AS n_train, count(*) AS n_test, slope, intercept, "
            "1 - sum((y - (intercept + slope * x)) ^ 2) / (var_pop(y) * count(*)) AS r2, "
            "sqrt(avg((y - (intercept + slope * x)) ^ 2)) AS rmse FROM d JOIN p2 USING (fold) "
            "GROUP BY d.fold, n_train, slope, intercept")


@register("cv_folds", sql=_cv_sql("bal"), doubles=["slope", "intercept", "r2", "rmse"])
def cv_folds(spark, sf_dir):
    return D.cv_linear(feature_mart(spark, sf_dir, with_key=True), "rk", "bal", TARGET, 5, 42)


def significance_sql() -> str:
    """The tail as the finite sums that whole degrees of freedom have (one for odd, one for even ones)."""
    even = "sin(th) * exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + 2 * k * ln(cos(th)))"
    odd = "2 / pi() * sin(th) * exp(lgamma(k + 1) + 0.5 * ln(pi()) - lgamma(k + 1.5) - ln(2) + (2 * k + 1) * ln(cos(th)))"
    return (matrix_cte() + ", tv AS (SELECT f1 AS feature, r, n, r * sqrt((n - 2) / (1 - r * r)) AS t_stat FROM c WHERE f2 = 'target' AND f1 <> 'target'), "
            "an AS (SELECT *, n - 2 AS d, atan(abs(t_stat) / sqrt(n - 2)) AS th FROM tv), "
            f"su AS (SELECT feature, sum(CASE WHEN d % 2 = 0 THEN {even} ELSE {odd} END) AS s "
            "FROM (SELECT *, unnest(range(CASE WHEN d % 2 = 0 THEN d // 2 ELSE (d - 1) // 2 END)) AS k FROM an) GROUP BY feature), "
            "pv AS (SELECT an.*, greatest(0, 1 - (CASE WHEN d % 2 = 0 THEN s ELSE 2 / pi() * th + s END)) AS p_value FROM an JOIN su USING (feature)) "
            "SELECT feature, r, n, t_stat, p_value, 0.05 / count(*) OVER () AS threshold, p_value < 0.05 / count(*) OVER () AS significant FROM pv")


@register("corr_significance", sql=significance_sql(), doubles=["r", "t_stat", "p_value", "threshold"])
def corr_significance(spark, sf_dir):
    """D3 on the target correlations: t = r sqrt((n-2)/(1-r^2)), two-sided p, Bonferroni."""
    return D.correlation_tests(mart_corr(spark, sf_dir), TARGET)


@register("opposing_pairs",
          sql=matrix_cte() + ", tv AS (SELECT f1 AS f, r AS rt FROM c WHERE f2 = 'target' AND f1 <> 'target') "
              "SELECT c.f1 AS feature1, c.f2 AS feature2, c.r AS pair_r, a.rt AS r1, b.rt AS r2 FROM c "
              "JOIN tv a ON a.f = c.f1 JOIN tv b ON b.f = c.f2 WHERE c.i < c.j AND abs(c.r) > 0.6 "
              "AND sign(a.rt) * sign(b.rt) < 0 AND abs(a.rt) > 0.3 AND abs(b.rt) > 0.3",
          doubles=["pair_r", "r1", "r2"])
def opposing_pairs(spark, sf_dir):
    return D.opposing_pairs(mart_corr(spark, sf_dir), TARGET, 0.6, 0.3)


@register("redundancy_rule",
          sql=matrix_cte() + ", tv AS (SELECT f1 AS f, r AS rt FROM c WHERE f2 = 'target' AND f1 <> 'target') "
              "SELECT c.f1 AS feature1, c.f2 AS feature2, c.r AS pair_r, a.rt AS r1, b.rt AS r2, "
              "CASE WHEN sign(a.rt) * sign(b.rt) < 0 THEN 'keep_both_add_cross_term' ELSE 'drop_one' END AS action "
              "FROM c JOIN tv a ON a.f = c.f1 JOIN tv b ON b.f = c.f2 WHERE c.i < c.j AND abs(c.r) > 0.85 "
              "AND c.f1 <> 'target' AND c.f2 <> 'target'",
          doubles=["pair_r", "r1", "r2"])
def redundancy_rule(spark, sf_dir):
    return D.redundancy_rule(mart_corr(spark, sf_dir), TARGET, 0.85)


@register("strength_bands",
          sql=matrix_cte() + "SELECT feature, r, CASE WHEN abs(r) > 0.5 THEN 'strong' WHEN abs(r) >= 0.15 THEN "
              "'moderate' WHEN r IS NOT NULL THEN 'weak' END AS band, CASE WHEN r > 0 THEN 'positive' ELSE "
              "'negative' END AS sign FROM (" + TARGET_VEC_SQL + ")",
          doubles=["r"])
def strength_bands(spark, sf_dir):
    from featlens.functions.scalar import sign_class
    tv = assoc.target_correlations(mart_corr(spark, sf_dir), TARGET)
    return tv.select("feature", "r", strength_band("r").alias("band"), sign_class("r").alias("sign"))


# ---------------------------------------------------------------- MLlib (rows-only checks)

def _split_mart(spark, sf_dir):
    from featlens.session import materialize
    m = mart_table(spark, sf_dir, with_key=True)      # the median and the split read it several times
    from featlens.operators.clean import impute
    filled = impute(m, "median", ["qty"])            # M7: fill before the split (reference parity)
    # the split table feeds several fits and metric passes: cut its lineage once (reliable
    # checkpoint in spark.checkpoint.dir) instead of recomputing join + split per pass
    return materialize(T.exact_split(filled, "rk", 0.2, 42))


def _experiment_row(name, res, n_features):
    return (res.train_metrics.select(F.col("r2").alias("train_r2"))
            .crossJoin(res.test_metrics.select(F.col("r2").alias("test_r2"), F.col("rmse").alias("test_rmse"),
                                               F.col("mae").alias("test_mae")))
            .select(F.lit(name).alias("model"), F.lit(n_features).cast("bigint").alias("features"), "*"))


@register("train_rf")
def train_rf(spark, sf_dir):
    res = T.train_and_evaluate(_split_mart(spark, sf_dir), MART_FEATURES, TARGET, "regression", "auto")
    return _experiment_row("random_forest", res, len(MART_FEATURES))


@register("train_gbt")
def train_gbt(spark, sf_dir):
    res = T.train_and_evaluate(_split_mart(spark, sf_dir), MART_FEATURES, TARGET, "regression",
                               "gradient_boosting")
    return _experiment_row("gradient_boosting", res, len(MART_FEATURES))


@register("train_logistic")
def train_logistic(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    d = T.stratified_split(lab.join(docs, "doc_id"), "doc_id", "quality")
    n = d.filter(~F.col("is_test")).count()
    res = T.train_and_evaluate(d, ["n_chars"], "quality", "classification", "logistic", regParam=1.0 / max(n, 1))
    return res.test_metrics


@register("importance")
def importance(spark, sf_dir):
    res = T.train_and_evaluate(_split_mart(spark, sf_dir), MART_FEATURES, TARGET, "regression", "auto")
    return T.feature_importance(res.model, MART_FEATURES, 15, spark)


@register("reintroduction_experiment")
def reintroduction_experiment(spark, sf_dir):
    """Direct / +reintroduced / +cross-term models on one exact split; % change vs direct."""
    corr = mart_corr(spark, sf_dir)
    st = L.initialize_pool(corr, TARGET, 0.25)
    refs = assoc.target_correlations(corr, TARGET).filter("rank <= 3").select("feature", F.col("rank").alias("ref_order"))
    promoted = L.promote(st, L.find_correlated(corr, st, refs, 0.25), 2)
    # feature-level lists (at most p names) drive the schema of the next steps
    rows = promoted.orderBy("pos").collect()
    direct = [r["feature"] for r in rows if r["status"] == "selected"]
    reintro = direct + [r["feature"] for r in rows if r["status"] == "reintroduced"]
    pairs = [(r["feature1"], r["feature2"]) for r in L.cross_term_pairs(promoted).orderBy("k").collect()]
    split = _split_mart(spark, sf_dir)
    enhanced = G.create_interactions(split, pairs, "multiply", original=MART_FEATURES)
    cross = MART_FEATURES + [f"{a}_X_{b}" for a, b in pairs]
    out = []
    for name, feats, data in (("direct", direct, split), ("reintroduced", reintro, split),
                              ("cross_terms", cross, enhanced)):
        res = T.train_and_evaluate(data, feats, TARGET, "regression", "auto")
        out.append(_experiment_row(name, res, len(feats)))
    table_ = T.stack_results(out)
    base = table_.filter("model = 'direct'").select(F.col("test_r2").alias("_b"))
    return table_.crossJoin(base).withColumn("change_pct", (F.col("test_r2") - F.col("_b")) / F.col("_b") * 100) \
        .drop("_b")


@register("workflow")
def workflow(spark, sf_dir):
    """Baseline against enhanced as one run, on the suggested pairs: both records side by side with the verdict."""
    m = mart_table(spark, sf_dir, with_key=True)      # joined once; the matrix, the split and the medians read the table
    corr = assoc.pearson_matrix(m, MART_COLUMNS)
    pairs = [(r["feature1"], r["feature2"])
             for r in assoc.suggest_pairs(corr, TARGET, 0.15, 0.80, 5).orderBy("rank").collect()]   # <= 5 names
    run = T.baseline_and_enhanced(m, "rk", TARGET, "regression", pairs,
                                  model_type="ridge", regParam=1e-3)
    return run.comparison


@register("valuable_features")
def valuable_features(spark, sf_dir):
    """Derived features (creation order) that rank among the forest's top importances."""
    corr = mart_corr(spark, sf_dir)
    pairs = assoc.suggest_pairs(corr, TARGET, 0.15, 0.80, 10).orderBy("rank").collect()   # <= 10 names
    plist = [(r["feature1"], r["feature2"]) for r in pairs]
    log = G.FeatureLog(original=list(MART_FEATURES))
    split = G.create_interactions(_split_mart(spark, sf_dir), plist, "multiply", original=MART_FEATURES, log=log)
    feats = list(MART_FEATURES) + log.created
    res = T.train_and_evaluate(split, feats, TARGET, "regression", "auto")
    imp = T.feature_importance(res.model, feats, 15, spark)
    created = spark.createDataFrame([(k, f) for k, f in enumerate(log.created)], "k int, feature string")
    return L.valuable_features(created, imp, 5)
