"""Modelling and evaluation.

Splits are exact and repeatable: rows are ordered by a 60-bit prefix of
``md5(key || '#' || seed)`` (same value in Spark and DuckDB) and the test set is every row
below the k-th hash, which a distributed selection finds (no ``limit(k)`` of a fifth of the
table into one task, no join of the table with its hashes). Learners are MLlib estimators; metrics are aggregates
over (label, prediction).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlens.functions.scalar import pct_change, verdict
from featlens.operators import trees
from featlens.operators.assoc import pair_moments
from featlens.operators.ranking import average_rank
from featlens.operators.selection import hash_threshold, hash_thresholds
from featlens.session import materialize, spread


def split_hash(key: Column, seed: int = 42) -> Column:
    """md5(key#seed) -> 60-bit integer; orders exactly like the hex digest prefix. A NULL key counts as empty."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(f"#{seed}"))), 1, 15), 16, 10) \
        .cast("bigint")


def exact_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: exactly ``ceil(n * test_size)`` rows with the smallest hashes.

    One hash is selected and goes out to the rows, which are flagged where they are."""
    h = df.withColumn("_h", split_hash(F.col(key), seed))
    at = hash_threshold(h, "_h", test_size)
    if at is None:      # no rows
        return h.withColumn("is_test", F.lit(False)).drop("_h")
    rows = h.withColumns({name: F.lit(value).cast("bigint") for name, value in zip(("_t", "_need", "_same"), at)})
    return _flag(rows, key, at[1] < at[2])


def _flag(rows: DataFrame, key: str, ties: bool, group=()) -> DataFrame:
    """``is_test`` from each row's threshold. Only where fewer rows are wanted than share the threshold's hash do
    those rows need an order: by key, and equal keys by a hash of the whole row."""
    whole = F.col("_need") == F.col("_same")
    out = rows.columns[:-4 - len(group)]
    if not ties:
        return rows.withColumn("is_test", (F.col("_h") < F.col("_t")) | ((F.col("_h") == F.col("_t")) & whole)).select(*out, "is_test")
    tied = (F.col("_h") == F.col("_t")) & ~whole
    clear = rows.where(~tied).withColumn("is_test", F.col("_h") <= F.col("_t"))
    some = rows.where(tied).withColumn("_row", F.xxhash64(*out))
    # (key, row hash) cells in order; a cell before the last wanted one is taken whole, equal rows of the last one by number
    cells = some.groupBy(*group, key, "_row", "_need").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*group).orderBy(key, "_row").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0))).where("_before < _need")
    cells = cells.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(key).alias("_k"), F.col("_row").alias("_r"), "_before", "_c")
    same = F.col("_row") == F.col("_r")
    for i, g in enumerate(group):
        same = same & (F.col(g) == F.col(f"_g{i}"))
    some = some.join(cells, same & F.col(key).eqNullSafe(F.col("_k")), "left")
    left = F.col("_need") - F.col("_before")
    full = some.where("_before is null or _before + _c <= _need").withColumn("is_test", F.col("_before").isNotNull())
    part = some.where("_before + _c > _need").withColumn("is_test", F.row_number().over(Window.partitionBy(*group, "_row").orderBy(key)) <= left)
    return clear.select(*out, "is_test").unionByName(full.select(*out, "is_test")).unionByName(part.select(*out, "is_test"))


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Per-class test quota by largest remainder (ties by class), then the smallest hashes within each class:
    one selected hash a class goes out to the rows."""
    # a NULL label is a class of its own: classes are joined by a text that NULL has too
    h = df.withColumn("_h", split_hash(F.col(key), seed)).withColumn("_class", F.to_json(F.struct(F.col(label))))
    kind = df.schema[label].dataType.simpleString()

    def quota(n):
        n = n.select("_class", F.col("n").cast("decimal(19,0)").alias("_nc"), F.from_json("_class", f"`{label}` {kind}")[label].alias("_label"))
        c = n.crossJoin(F.broadcast(n.agg(F.sum("_nc").alias("_n")))).withColumn(
            "_k", F.ceil(F.col("_n") * F.lit(test_size))).withColumn(
            "_exact", F.col("_nc").cast("double") * F.col("_k").cast("double") / F.col("_n").cast("double")).withColumn("_base", F.floor("_exact"))
        w = Window.orderBy((F.col("_exact") - F.col("_base")).desc(), "_label")      # over classes
        left = F.col("_k") - F.sum("_base").over(Window.partitionBy())
        return c.withColumn("_r", F.row_number().over(w)).select(
            "_class", (F.col("_base") + F.when(F.col("_r") <= left, 1).otherwise(0)).cast("bigint").alias("quota"))
    at = hash_thresholds(h.select("_class", "_h"), "_h", quota, "_class")     # one row a class, broadcast if Catalyst finds it small
    ties = at.where("_need < _same").limit(1).count() > 0
    rows = h.join(at, "_class").select(*df.columns, "_class", "_h", "_t", "_need", "_same")
    return _flag(rows, key, ties, ["_class"])


@dataclass(frozen=True)
class ScalerModel:
    """T4: mean / population std fitted on the training rows only."""
    features: tuple
    stats: DataFrame     # one row: _m{k}, _s{k}

    def transform(self, df: DataFrame) -> DataFrame:
        joined = df.crossJoin(F.broadcast(self.stats))
        new = {}
        for k, f in enumerate(self.features):
            centred = F.col(f).cast("double") - F.col(f"_m{k}")
            new[f] = F.when(F.col(f"_s{k}") > 0, centred / F.col(f"_s{k}")).otherwise(centred)
        return joined.withColumns(new).drop(*[f"_m{k}" for k in range(len(self.features))],
                                            *[f"_s{k}" for k in range(len(self.features))])


def fit_scaler(train: DataFrame, features: list[str]) -> ScalerModel:
    stats = train.agg(*[F.avg(F.col(f).cast("double")).alias(f"_m{k}") for k, f in enumerate(features)],
                      *[F.stddev_pop(F.col(f).cast("double")).alias(f"_s{k}") for k, f in enumerate(features)])
    return ScalerModel(tuple(features), stats)


# ---------------------------------------------------------------- metrics

def _regression_sums(y: Column, p: Column, tag: str = "") -> tuple[list[Column], list[Column]]:
    """(aggregates, metrics from them) of R^2, RMSE and MAE."""
    n, sse = F.col(f"_n{tag}"), F.col(f"_sse{tag}")
    sums = [F.sum((y - p) * (y - p)).alias(f"_sse{tag}"), F.var_pop(y).alias(f"_vy{tag}"), F.count(F.lit(1)).alias(f"_n{tag}"), F.avg(F.abs(y - p)).alias(f"_mae{tag}")]
    return sums, [(F.lit(1.0) - F.try_divide(sse, F.col(f"_vy{tag}") * n)).alias("r2"), F.sqrt(sse / n).alias("rmse"), F.col(f"_mae{tag}").alias("mae")]


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R^2, RMSE, MAE."""
    sums, metrics = _regression_sums(F.col(label).cast("double"), F.col(prediction).cast("double"))
    return pred.agg(*sums).select(metrics)


def regression_metrics_of(pred: DataFrame, label: str, predictions: list[str]) -> list[DataFrame]:
    """T10 for several predictions of one table: one scan, one row of sums, then a table of metrics each."""
    y, sums, metrics = F.col(label).cast("double"), [], []
    for k, p in enumerate(predictions):
        s, m = _regression_sums(y, F.col(p).cast("double"), str(k))
        sums, metrics = sums + s, metrics + [m]
    row = materialize(pred.agg(*sums))
    return [row.select(m) for m in metrics]


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (zero division -> 0)."""
    cm = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    classes = cm.select(F.col("y").alias("k")).union(cm.select(F.col("p").alias("k"))).distinct()
    tp = cm.filter(F.col("y") == F.col("p")).select(F.col("y").alias("k"), F.col("c").alias("tp"))
    sup = cm.groupBy(F.col("y").alias("k")).agg(F.sum("c").alias("support"))
    pp = cm.groupBy(F.col("p").alias("k")).agg(F.sum("c").alias("pred_pos"))
    per = (classes.join(tp, "k", "left").join(sup, "k", "left").join(pp, "k", "left").na.fill(0)
           .withColumn("prec", F.coalesce(F.try_divide(F.col("tp"), F.col("pred_pos")), F.lit(0.0)))
           .withColumn("rec", F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0)))
           .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("prec") * F.col("rec"),
                                                     F.col("prec") + F.col("rec")), F.lit(0.0))))
    return per.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("rec") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Confusion counts ``(label, prediction, count)``."""
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """AUC by Mann-Whitney on average score ranks; NULL unless exactly two classes
    (the larger label is positive). Rows without a score or label play no part; counts are doubles,
    so that their products cannot overflow."""
    pred = pred.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    lab = pred.agg(F.count_distinct(F.col(label)).alias("_nc"), F.max(F.col(label)).alias("_pos"))
    ranked = average_rank(pred.select(F.col(label).alias("_y"), F.col(score).cast("double").alias("_s")),
                          "_s", None, "_rank")
    j = ranked.crossJoin(F.broadcast(lab))
    s = j.agg(F.first("_nc").alias("_nc"),
              F.sum(F.when(F.col("_y") == F.col("_pos"), F.col("_rank"))).alias("_rs"),
              F.count(F.when(F.col("_y") == F.col("_pos"), 1)).cast("double").alias("_n1"),
              F.count(F.when(F.col("_y") != F.col("_pos"), 1)).cast("double").alias("_n0"))
    auc = F.try_divide(F.col("_rs") - F.col("_n1") * (F.col("_n1") + 1) / 2.0, F.col("_n1") * F.col("_n0"))
    return s.select(F.when(F.col("_nc") == 2, auc).alias("roc_auc"))


def compare_models(baseline: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Metrics side by side, improvement % on the headline metric, verdict.

    Both inputs are one-row metric tables with the same columns; the headline metric is
    ``accuracy`` if present, else ``r2``.
    """
    metric = "accuracy" if "accuracy" in baseline.columns else "r2"
    b = baseline.select([F.col(c).alias(f"baseline_{c}") for c in baseline.columns])
    e = enhanced.select([F.col(c).alias(f"enhanced_{c}") for c in enhanced.columns])
    imp = pct_change(F.col(f"enhanced_{metric}"), F.col(f"baseline_{metric}"))
    return b.crossJoin(e).withColumn("metric", F.lit(metric)).withColumn("improvement_pct", imp) \
        .withColumn("verdict", verdict(F.col("improvement_pct")))


def stack_results(rows: list[DataFrame]) -> DataFrame:
    """Union of result records with the union of their columns."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def metric_delta(baseline: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Enhanced - baseline per metric (long form)."""
    cols = [c for c in baseline.columns if c in enhanced.columns]
    b = baseline.select([F.col(c).alias(f"b_{c}") for c in cols])
    e = enhanced.select([F.col(c).alias(f"e_{c}") for c in cols])
    j = b.crossJoin(e)
    return j.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"b_{c}").alias("baseline"),
                                                 F.col(f"e_{c}").alias("enhanced"),
                                                 (F.col(f"e_{c}") - F.col(f"b_{c}")).alias("delta"))
                                        for c in cols])).alias("m")).select("m.*")


# ---------------------------------------------------------------- closed-form OLS

def ols_r2(df: DataFrame, xs: list[str], y: str) -> float:
    """In-sample R^2 of y on xs (with intercept) on complete rows, from one Gram pass.

    Only the (p+1)^2 moment matrix reaches the driver; the solve is p x p.
    """
    cols = list(xs) + [y]
    d = df.select([F.col(c).cast("double") for c in cols]).dropna()
    mom = pair_moments(d, cols).select("i", "j", "cxy", "n").collect()
    p = len(cols)
    cov = np.zeros((p, p))
    for r in mom:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cxy"]
    sxx, sxy, syy = cov[:-1, :-1], cov[:-1, -1], cov[-1, -1]
    if syy <= 0:
        return float("nan")
    beta = np.linalg.lstsq(sxx, sxy, rcond=None)[0]
    return float(beta @ sxy / syy)


def r2_from_correlations(r: dict, xs: list[str], y: str) -> float:
    """R^2 = c' R^-1 c from a correlation lookup ``r[(a, b)]``."""
    p = len(xs)
    R = np.array([[1.0 if a == b else r[(a, b)] for b in xs] for a in xs])
    c = np.array([r[(a, y)] for a in xs])
    return float(c @ np.linalg.solve(R, c)) if p else 0.0


def pair_study(df: DataFrame, a: str, b: str, target: str) -> DataFrame:
    """R^2 of a, b, a+b, a+b+a*b (in-sample OLS on complete rows) and the gains."""
    d = df.select(F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b),
                  F.col(target).cast("double").alias(target)).dropna() \
        .withColumn(f"{a}_X_{b}", F.col(a) * F.col(b))
    cols = [a, b, f"{a}_X_{b}", target]
    mom = pair_moments(d, cols).select("i", "j", "cxx", "cyy", "cxy").collect()
    cov = np.zeros((4, 4))
    for r in mom:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["cxy"]
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    look = {(cols[i], cols[j]): corr[i, j] for i in range(4) for j in range(4)}
    r_a = r2_from_correlations(look, [a], target)
    r_b = r2_from_correlations(look, [b], target)
    r_ab = r2_from_correlations(look, [a, b], target)
    r_abx = r2_from_correlations(look, [a, b, f"{a}_X_{b}"], target)
    gain = (r_ab - r_a) / r_a * 100 if r_a else float("nan")
    extra = (r_abx - r_ab) / r_ab * 100 if r_ab else float("nan")
    return df.sparkSession.createDataFrame(
        [(a, b, r_a, r_b, r_ab, r_abx, gain, extra)],
        "feature1 string, feature2 string, r2_feature1 double, r2_feature2 double, r2_both double, "
        "r2_with_product double, gain_vs_feature1_pct double, product_extra_pct double")


# ---------------------------------------------------------------- MLlib learners

def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def make_learner(task: str, model_type: str = "auto", seed: int = 42, classes: int = 2, rows: int | None = None, **params):
    """The reference's learner families on MLlib.

    Boosting takes one model per class if there are more than two ``classes``. Logistic regression
    has an L2 penalty of one over the number of training ``rows`` (the inverse strength 1 of a summed
    loss, as MLlib averages it) unless ``regParam`` is given.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    reg = task == "regression"
    if model_type in ("auto", "random_forest"):
        depth = 10 if model_type == "auto" else 30
        # maxMemoryInMB / cacheNodeIds only change how many tree nodes each pass splits
        # (fewer passes over the data), not the fitted trees
        kw = dict(numTrees=100, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features",
                  maxMemoryInMB=1024, cacheNodeIds=True)
        kw.update(params)
        if reg:
            return RandomForestRegressor(featureSubsetStrategy="all", **kw)
        return RandomForestClassifier(**kw)
    if model_type == "gradient_boosting":
        kw = dict(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, labelCol="label", featuresCol="features",
                  maxMemoryInMB=1024, cacheNodeIds=True)
        kw.update(params)
        if reg:
            return GBTRegressor(**kw)
        one = GBTClassifier(**kw)
        return one if classes <= 2 else OneVsRest(classifier=one, labelCol="label", featuresCol="features")
    if model_type == "logistic":
        if reg:
            raise ValueError("logistic regression needs a classification task")
        kw = dict(maxIter=1000, elasticNetParam=0.0, standardization=False, labelCol="label",
                  featuresCol="features", regParam=1.0 / rows if rows else 0.0)
        kw.update(params)
        return LogisticRegression(**kw)
    if model_type in ("linear", "ridge", "lasso", "elastic_net"):
        alpha = params.pop("regParam", 1.0 if model_type != "linear" else 0.0)
        mix = {"linear": 0.0, "ridge": 0.0, "lasso": 1.0, "elastic_net": 0.5}[model_type]
        return LinearRegression(regParam=alpha, elasticNetParam=mix, labelCol="label",
                                featuresCol="features", **params)
    raise ValueError(f"unknown model type {model_type!r}")


@dataclass
class TrainResult:
    model: object
    features: list
    train_metrics: DataFrame
    test_metrics: DataFrame
    test_predictions: DataFrame
    name: str = "auto"
    #: The classes by label number (classification only).
    classes: tuple = ()
    data: DataFrame | None = None

    def record(self) -> DataFrame:
        """One row: model_name, n_features, train_* and test_* for every metric."""
        sides = [m.select([F.col(c).alias(f"{side}_{c}") for c in m.columns])
                 for side, m in (("train", self.train_metrics), ("test", self.test_metrics))]
        return sides[0].crossJoin(sides[1]).select(F.lit(self.name).alias("model_name"),
                                                   F.lit(len(self.features)).cast("bigint").alias("n_features"), "*")

    def release(self) -> None:
        """Gives up the cached training table, if there is one; metrics asked for later are computed anew."""
        if self.data is not None:
            self.data.unpersist()


def _scored_metrics(pred: DataFrame, classes: int) -> DataFrame:
    """The classifier's metrics and, for two classes, the AUC of the larger class's score."""
    from pyspark.ml.functions import vector_to_array
    m = classification_metrics(pred)
    if classes != 2 or "probability" not in pred.columns:
        return m.withColumn("roc_auc", F.lit(None).cast("double"))
    return m.crossJoin(roc_auc(pred.select("label", vector_to_array("probability")[1].alias("score"))))


def _few_passes(task: str, model_type: str, vec: DataFrame, features: list[str], params: dict) -> bool:
    """Whether the learner reads its rows so seldom, or from tables of its own, that a cached copy of all vectors is not worth its disk:
    linear models from the normal equations (one pass) and the trees of ``trees``."""
    from pyspark.ml.regression import LinearRegression
    if task != "regression":
        return False
    learner = make_learner(task, model_type, **params)
    if isinstance(learner, LinearRegression):
        return learner.getSolver() == "normal" or (learner.getSolver() == "auto" and len(features) <= 4096)
    return trees.handled(learner, vec)


def train_and_evaluate(split: DataFrame, features: list[str], target: str, task: str,
                       model_type: str = "auto", scale: bool = True, **params) -> TrainResult:
    """Scale on train, fit, score train and test (same split reused by callers).

    Classes of any type are numbered in ascending order (one model output each, so the class list is small).
    """
    classes = ()
    even = spread(split)        # every pass of a learner runs in as many tasks as hold rows
    split = even if even is split else materialize(even)        # dealt out once, not for every pass
    label = F.col(target).cast("double")
    if task != "regression":
        classes = tuple(r[0] for r in split.select(target).where(F.col(target).isNotNull()).distinct().orderBy(target).collect())
        kind = split.schema[target].dataType
        label = (F.array_position(F.array(*[F.lit(c).cast(kind) for c in classes]), F.col(target)) - 1).cast("double")
    data = split.select(*features, label.alias("label"), "is_test")
    train = data.filter(~F.col("is_test"))
    if scale:
        scaler = fit_scaler(train, features)
        data = scaler.transform(data)
    vec = assemble(data, features)
    if not _few_passes(task, model_type, vec, features, params):
        vec = vec.persist()         # reused by fit and both metric passes
    tr, te = vec.filter(~F.col("is_test")), vec.filter(F.col("is_test"))
    rows = tr.count() if model_type == "logistic" and "regParam" not in params else None
    model = trees.fit(make_learner(task, model_type, classes=len(classes), rows=rows, **params), tr, features)
    ptr, pte = model.transform(tr), model.transform(te)
    metric = regression_metrics if task == "regression" else lambda p: _scored_metrics(p, len(classes))
    return TrainResult(model, list(features), metric(ptr), metric(pte), pte, model_type, classes, vec)


def feature_importance(model, features: list[str], top: int | None = 15, spark=None) -> DataFrame:
    """Tree importances or |coefficients| (max over classes), desc; neither -> empty."""
    spark = spark or __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    vals = None
    if hasattr(model, "featureImportances"):
        vals = list(model.featureImportances.toArray())
    elif hasattr(model, "coefficientMatrix"):
        vals = list(np.abs(model.coefficientMatrix.toArray()).max(axis=0))
    elif hasattr(model, "coefficients"):
        vals = list(np.abs(model.coefficients.toArray()))
    rows = [] if vals is None else [(f, float(v), k) for k, (f, v) in enumerate(zip(features, vals))]
    df = spark.createDataFrame(rows, "feature string, importance double, pos int")
    w = Window.orderBy(F.col("importance").desc(), "pos")
    df = df.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return df.filter(F.col("rank") <= top) if top else df


def prepare_data(df: DataFrame, target: str, fit_on: str = "all"):
    """Drop the target from the predictors, median-fill numeric predictors (fit on all
    rows for parity; ``fit_on='train'`` expects an ``is_test`` column), keep numeric columns.
    Returns (prepared DataFrame, describe table)."""
    from featlens.operators.assoc import numeric_features
    from featlens.operators.clean import fit_imputer
    from featlens.operators.profile import describe
    feats = numeric_features(df, target)
    base = df.filter(~F.col("is_test")) if fit_on == "train" else df
    imp = fit_imputer(base, "median", [c for c in feats])
    extra = ["is_test"] if "is_test" in df.columns else []
    prepared = imp.transform(df).select(*feats, target, *extra)
    return prepared, describe(prepared, feats)


def train_enhanced(split: DataFrame, baseline: list[str], derived: list[str], target: str, task: str,
                   model_type: str = "auto", **params) -> TrainResult:
    """The same learner on the original plus the derived columns present in the table."""
    if model_type not in ("auto", "random_forest", "gradient_boosting", "logistic", "linear", "ridge",
                          "lasso", "elastic_net"):
        raise ValueError(f"unknown model type {model_type!r}")
    have = set(split.columns)
    feats = list(baseline) + [c for c in derived if c in have and c not in baseline]
    return train_and_evaluate(split, feats, target, task, model_type, **params)


@dataclass
class Workflow:
    baseline: TrainResult
    enhanced: TrainResult
    comparison: DataFrame
    described: DataFrame


def baseline_and_enhanced(df: DataFrame, key: str, target: str, task: str, pairs: list[tuple[str, str]],
                          operation: str = "multiply", model_type: str = "auto", test_size: float = 0.2,
                          seed: int = 42, save_to: str | None = None, **params) -> Workflow:
    """The whole run: one exact split (by class for classification), prepared predictors, a baseline model,
    the same learner with a derived column for each pair of features, and the comparison of the two on the
    same test rows. ``key`` only names the rows and is no predictor. With ``save_to`` both models are saved.
    """
    from featlens.operators.features import create_interactions
    from featlens.sources.sinks import save_models
    cut = (exact_split(df, key, test_size, seed) if task == "regression"
           else stratified_split(df, key, target, test_size, seed))
    prepared, described = prepare_data(cut.drop(key), target)
    prepared = materialize(prepared)     # read by both models
    original = [c for c in prepared.columns if c not in (target, "is_test")]
    wide = create_interactions(prepared, pairs, operation, original=original)
    derived = [c for c in wide.columns if c not in prepared.columns]
    baseline = train_and_evaluate(prepared, original, target, task, model_type, **params)
    enhanced = train_enhanced(wide, original, derived, target, task, model_type, **params)
    if save_to is not None:
        save_models({"baseline": baseline.model, "enhanced": enhanced.model},
                    {name: f"{save_to}/{name}" for name in ("baseline", "enhanced")})
    return Workflow(baseline, enhanced, compare_models(baseline.test_metrics, enhanced.test_metrics), described)


def importance_first(importance: DataFrame, n: int = 10) -> DataFrame:
    """Importances of the first ``n`` features (column order), ascending."""
    return importance.filter(F.col("pos") < n).orderBy("importance", "pos")
