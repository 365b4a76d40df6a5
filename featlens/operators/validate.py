"""Validation rules the reference documents (D1-D11): k-fold CV, paired t-test,
Bonferroni, opposing/redundant pair rules, complexity checks. Cross-validation of feature lists, PCA (D10)
and grid search (D9, D11) work on moment blocks, in ``gram``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.functions.scalar import strength_band  # noqa: F401 (D6 lives in functions)
from featlens.functions.student import t_two_sided
from featlens.operators.model import split_hash


def fold_of(key: str, k: int = 5, seed: int = 42):
    """Deterministic fold id in [0, k) from the split hash."""
    return F.pmod(split_hash(F.col(key), seed), F.lit(k)).cast("int")


def cv_linear(df: DataFrame, key: str, x: str, y: str, k: int = 5, seed: int = 42) -> DataFrame:
    """D1 for one predictor: k-fold CV of the least-squares line y ~ x from one scan (fold moment blocks), with
    the line of every fold. Lists of predictors, mean and deviation: ``gram.cross_validated``."""
    from featlens.operators import gram
    blocks = gram.fold_moments(df, [x, y], fold_of(key, k, seed), k)
    rows = []
    for fold, train, held in gram._leave_one_out(blocks):
        line = gram.elastic_net(train, [x], y)
        rows.append((fold, train.n, held.n, float(line.weights[0]), line.intercept, *line.errors(held, y)))
    rows = [tuple(None if v != v else v for v in r) for r in rows]
    return df.sparkSession.createDataFrame(rows, "fold int, n_train bigint, n_test bigint, slope double, intercept double, r2 double, rmse double")


def paired_t(scores: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Paired t-test on per-fold scores (b - a); p-value two-sided."""
    d = F.col(b) - F.col(a)
    st = scores.agg(F.count(F.lit(1)).alias("k"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    st = st.withColumn("t_stat", F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt(F.col("k"))))
    p = t_two_sided(F.col("t_stat"), F.col("k") - 1)
    return st.withColumn("p_value", p).withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def correlation_tests(corr: DataFrame, target: str, alpha: float = 0.05) -> DataFrame:
    """D3 on the target's correlations: ``feature, r, n, t_stat, p_value, threshold, significant``, t = r sqrt((n-2)/(1-r^2))."""
    tv = corr.filter((F.col("f2") == target) & (F.col("f1") != target))
    t = tv.withColumn("t_stat", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    t = t.withColumn("p_value", t_two_sided(F.col("t_stat"), F.col("n") - 2))
    return bonferroni(t.select(F.col("f1").alias("feature"), "r", "n", "t_stat", "p_value"), alpha=alpha)


def bonferroni(pvalues: DataFrame, p_col: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """D3: per-test threshold alpha / m and the significance flag."""
    m = pvalues.agg(F.count(F.lit(1)).alias("_m"))
    return (pvalues.crossJoin(F.broadcast(m)).withColumn("threshold", F.lit(alpha) / F.col("_m"))
            .withColumn("significant", F.col(p_col) < F.col("threshold")).drop("_m"))


def opposing_pairs(corr: DataFrame, target: str, min_pair: float = 0.6, min_target: float = 0.3) -> DataFrame:
    """|r_ab| > min_pair, opposite target signs, both |r_t| > min_target (upper triangle)."""
    tv = corr.filter((F.col("f2") == target) & (F.col("f1") != target)).select(F.col("f1").alias("_f"),
                                                                            F.col("r").alias("_rt"))
    m = corr.filter((F.col("i") < F.col("j")) & (F.col("f1") != target) & (F.col("f2") != target)
                    & (F.abs("r") > min_pair))
    j = (m.join(F.broadcast(tv.toDF("f1", "r1")), "f1").join(F.broadcast(tv.toDF("f2", "r2")), "f2")
         .filter((F.signum("r1") * F.signum("r2") < 0) & (F.abs("r1") > min_target) & (F.abs("r2") > min_target)))
    return j.select(F.col("f1").alias("feature1"), F.col("f2").alias("feature2"), F.col("r").alias("pair_r"),
                    "r1", "r2")


def redundancy_rule(corr: DataFrame, target: str, threshold: float = 0.85) -> DataFrame:
    """For redundant pairs, same target sign -> drop one, opposite -> keep both + cross term."""
    tv = corr.filter((F.col("f2") == target) & (F.col("f1") != target)).select(F.col("f1").alias("_f"),
                                                                            F.col("r").alias("_rt"))
    m = corr.filter((F.col("i") < F.col("j")) & (F.col("f1") != target) & (F.col("f2") != target)
                    & (F.abs("r") > threshold))
    j = m.join(F.broadcast(tv.toDF("f1", "r1")), "f1").join(F.broadcast(tv.toDF("f2", "r2")), "f2")
    action = F.when(F.signum("r1") * F.signum("r2") < 0, "keep_both_add_cross_term").otherwise("drop_one")
    return j.select(F.col("f1").alias("feature1"), F.col("f2").alias("feature2"), F.col("r").alias("pair_r"),
                    "r1", "r2", action.alias("action"))


def complexity_check(n_rows: DataFrame, n_features: int, train_r2: str = "train_r2",
                     test_r2: str = "test_r2", gap_limit: float = 0.2) -> DataFrame:
    """Feature budget (features < 20 % of rows, rows > 20 x features) and train-test gap."""
    return n_rows.select(
        "*", F.lit(n_features).alias("n_features"),
        (F.lit(n_features) < F.col("n_rows") * 0.2).alias("within_budget"),
        (F.col("n_rows") > F.lit(20 * n_features)).alias("enough_rows"),
        (F.col(train_r2) - F.col(test_r2)).alias("gap"),
        ((F.col(train_r2) - F.col(test_r2)) > gap_limit).alias("overfit"))
