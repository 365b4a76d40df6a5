"""Association statistics (C1-C15): correlation matrices in long form and the
feature-level operators built on them.

Long matrix schema: ``i INT, j INT, f1 STRING, f2 STRING, r DOUBLE, n BIGINT`` with both
orders and the diagonal; ``i``/``j`` are positions in the input column list.

Pearson kernel: every partition reduces its rows to centred pairwise-complete co-moments
(numpy on Arrow batches, p x p matrix products), the partition results are checkpointed
(partitions x p^2 rows, independent of row count) and merged with the exact parallel
co-moment formula in two partial aggregations. One scan of the input; no per-pair Spark
expressions (hundreds of ``corr`` aggregates do not fit whole-stage codegen).

Everything after the matrix touches feature-level tables (p or p^2 rows).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from featlens.functions.scalar import is_numeric_type
from featlens.session import ensure_checkpoint_dir, materialize

MOMENT_SCHEMA = StructType([
    StructField("i", IntegerType()), StructField("j", IntegerType()),
    StructField("n", LongType()),
    StructField("mx", DoubleType()), StructField("my", DoubleType()),
    StructField("cxx", DoubleType()), StructField("cyy", DoubleType()), StructField("cxy", DoubleType()),
    StructField("lox", DoubleType()), StructField("hix", DoubleType()),
    StructField("loy", DoubleType()), StructField("hiy", DoubleType()),
])
_ARROW_MOMENTS = pa.schema([(f.name, pa.int32() if f.name in ("i", "j") else
                             pa.int64() if f.name == "n" else pa.float64()) for f in MOMENT_SCHEMA.fields])


#: Ranks of a column with at most about so many values are looked up by a broadcast join, not by a shuffle of its entries.
FEW_VALUES = 50_000


def numeric_features(df: DataFrame, target: str | None = None, keep_target: bool = False) -> list[str]:
    """numeric columns (bool excluded) in schema order; target removed or moved last."""
    cols = [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    if target is not None and target in cols:
        cols.remove(target)
        if keep_target:
            cols.append(target)
    return cols


# ---------------------------------------------------------------- Pearson kernel

def _moments_fn(p: int):
    iu, ju = np.triu_indices(p)

    def fn(batches):
        n = sx = sxx = sxy = lo = hi = shift = None
        for b in batches:
            if b.num_rows == 0:
                continue
            x = np.column_stack([np.asarray(b.column(k).to_numpy(zero_copy_only=False), dtype=np.float64)
                                 for k in range(p)])
            m = ~np.isnan(x)
            if shift is None:  # per-partition shift keeps the sums well conditioned
                with np.errstate(all="ignore"):
                    shift = np.nan_to_num(np.nanmean(x, axis=0))
                n, sx, sxx, sxy = (np.zeros((p, p)) for _ in range(4))
                lo, hi = np.full((p, p), np.inf), np.full((p, p), -np.inf)
            mf = m.astype(np.float64)
            z = np.where(m, x - shift, 0.0)
            n += mf.T @ mf
            sx += z.T @ mf          # sx[i, j]: sum of x_i over rows where x_i and x_j are present
            sxx += (z * z).T @ mf
            sxy += z.T @ z
            for k in range(p):      # exact min/max of x_k over rows shared with each partner
                both = m & m[:, [k]]
                lo[k] = np.minimum(lo[k], np.where(both, x[:, [k]], np.inf).min(axis=0))
                hi[k] = np.maximum(hi[k], np.where(both, x[:, [k]], -np.inf).max(axis=0))
        if n is None:
            return
        keep = n[iu, ju] > 0
        i, j = iu[keep], ju[keep]
        nn = n[i, j]
        sxi, syj = sx[i, j], sx[j, i]
        cols = [i.astype(np.int32), j.astype(np.int32), nn.astype(np.int64),
                sxi / nn + shift[i], syj / nn + shift[j],
                np.maximum(sxx[i, j] - sxi * sxi / nn, 0.0), np.maximum(sxx[j, i] - syj * syj / nn, 0.0),
                sxy[i, j] - sxi * syj / nn, lo[i, j], hi[i, j], lo[j, i], hi[j, i]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_ARROW_MOMENTS)

    return fn


def _pair_list_fn(p: int, pairs: list[tuple[int, int]]):
    """The same for a list of pairs: cost and output follow the list, not the square of the columns."""
    def fn(batches):
        shift = acc = None
        for b in batches:
            if b.num_rows == 0:
                continue
            x = [np.asarray(b.column(k).to_numpy(zero_copy_only=False), dtype=np.float64) for k in range(p)]
            there = [~np.isnan(v) for v in x]
            if shift is None:
                shift = [float(v[m].mean()) if m.any() else 0.0 for v, m in zip(x, there)]
                acc = np.zeros((len(pairs), 6))
                lo, hi = np.full((len(pairs), 2), np.inf), np.full((len(pairs), 2), -np.inf)
            for k, (i, j) in enumerate(pairs):
                both = there[i] & there[j]
                u, v = x[i][both], x[j][both]
                if len(u):
                    lo[k] = np.minimum(lo[k], (u.min(), v.min()))
                    hi[k] = np.maximum(hi[k], (u.max(), v.max()))
                    u, v = u - shift[i], v - shift[j]
                    acc[k] += len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v
        if acc is None:
            return
        keep = np.flatnonzero(acc[:, 0])
        i, j = np.array(pairs)[keep].T if len(keep) else (np.empty(0, int), np.empty(0, int))
        n, su, sv, suu, svv, suv = acc[keep].T
        off = np.array(shift)
        cols = [i.astype(np.int32), j.astype(np.int32), n.astype(np.int64), su / n + off[i], sv / n + off[j],
                np.maximum(suu - su * su / n, 0.0), np.maximum(svv - sv * sv / n, 0.0), suv - su * sv / n,
                lo[keep, 0], hi[keep, 0], lo[keep, 1], hi[keep, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_ARROW_MOMENTS)

    return fn


def pair_moments(df: DataFrame, cols: list[str], pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """Merged pairwise-complete co-moments for every i <= j, or for the wanted ``pairs`` of column numbers.

    Columns: i, j, n, mean_x, mean_y, cxx, cyy, cxy (centred sums), lox/hix/loy/hiy.
    """
    ensure_checkpoint_dir(df.sparkSession)
    x = df.select([F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(cols)])
    kernel = _moments_fn(len(cols)) if pairs is None else _pair_list_fn(len(cols), list(pairs))
    part = materialize(x.mapInArrow(kernel, MOMENT_SCHEMA))
    means = part.groupBy("i", "j").agg(
        F.sum("n").alias("_tot"),
        (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("gx"),
        (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("gy"))
    # ``means`` has at most p(p+1)/2 rows (p = number of columns): a schema-bounded broadcast.
    dx = F.col("mx") - F.col("gx")
    dy = F.col("my") - F.col("gy")
    return (part.join(F.broadcast(means), ["i", "j"])
            .groupBy("i", "j")
            .agg(F.first("_tot").alias("n"), F.first("gx").alias("mean_x"), F.first("gy").alias("mean_y"),
                 F.sum(F.col("cxx") + F.col("n") * dx * dx).alias("cxx"),
                 F.sum(F.col("cyy") + F.col("n") * dy * dy).alias("cyy"),
                 F.sum(F.col("cxy") + F.col("n") * dx * dy).alias("cxy"),
                 F.min("lox").alias("lox"), F.max("hix").alias("hix"),
                 F.min("loy").alias("loy"), F.max("hiy").alias("hiy")))


def _r_from_moments() -> Column:
    const = (F.col("lox") == F.col("hix")) | (F.col("loy") == F.col("hiy"))
    r = F.try_divide(F.col("cxy"), F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy")))
    wild = F.isnan(r) | F.isnan("cxx") | F.isnan("cyy") | (F.abs("cxx") == F.lit(float("inf"))) | (F.abs("cyy") == F.lit(float("inf")))
    return F.when(const | (F.col("n") < 2) | wild, F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _mirror(upper: DataFrame, names: list[str]) -> DataFrame:
    """Rows for i <= j -> both orders (diagonal once) + feature names."""
    fwd = F.struct(F.col("i").alias("a"), F.col("j").alias("b"), "r", "n")
    rev = F.struct(F.col("j").alias("a"), F.col("i").alias("b"), "r", "n")
    both = upper.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(fwd))
                                  .otherwise(F.array(fwd, rev))).alias("e")).select("e.*")
    name_arr = F.array(*[F.lit(nm) for nm in names])
    return both.select(
        F.col("a").alias("i"), F.col("b").alias("j"),
        F.element_at(name_arr, F.col("a") + 1).alias("f1"),
        F.element_at(name_arr, F.col("b") + 1).alias("f2"),
        F.col("r"), F.col("n").cast("bigint").alias("n"))


def pearson_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson matrix (long form, both orders + diagonal)."""
    upper = pair_moments(df, cols).select("i", "j", _r_from_moments().alias("r"), "n")
    return _mirror(upper, cols)


def spearman_matrix(df: DataFrame, cols: list[str], buckets: int = 64) -> DataFrame:
    """Spearman = Pearson on average ranks, ranks taken on each pair's complete rows.

    The rank of x_a within the rows where partner x_b is present only depends on b's null
    mask, so one ranking per column carries, besides the plain count, a conditional count
    for every nullable partner (``extra_sums``); p groups, not p^2.

    Plan (two shuffles of the stacked entries of the columns with many values, independent of p^2):

    1. the rows get a unique id once, in a table written to the checkpoint folder (the
       row <-> id pairing is then fixed for every later task, retried or not);
    2. rows are stacked to ``(rid, s, v, presence bits)``, and cells ``(s, v)`` get
       distributed prefix-sum ranks (a hot value is one cell);
    3. a column with at most ``FEW_VALUES`` values gets its ranks from a broadcast table, in the rows as they lie;
    4. for the others, one equi-join on ``(s, v)`` puts the ranks on the entries (AQE splits a hot value's
       partition), and one ``groupBy(rid)`` with conditional aggregates rebuilds the rank columns, which meet the
       rows' other ranks in a join on ``rid``;
    5. the Gram kernel correlates them pairwise-complete: pair (a, b) reads corr(R[a|b], R[b|a]).
    """
    from featlens.functions.scalar import normalise_nans
    from featlens.operators.ranking import ordered_cells
    p = len(cols)
    if p < 2:
        return pearson_matrix(df, cols)
    x = normalise_nans(df.select([F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(cols)]))
    fixed = materialize(x.withColumn("_rid", F.monotonically_increasing_id()))
    stats = fixed.agg(*[F.count(f"_x{k}").alias(f"_n{k}") for k in range(p)],
                      *[(F.max(f"_x{k}") > F.min(f"_x{k}")).alias(f"_v{k}") for k in range(p)],
                      *[F.approx_count_distinct(f"_x{k}").alias(f"_d{k}") for k in range(p)],
                      F.count(F.lit(1)).alias("_rows")).first()          # 3p + 1 scalars
    nullable = [k for k in range(p) if stats[f"_n{k}"] < stats["_rows"]]
    bit = {m: (f"_pm{i // 62}", i % 62) for i, m in enumerate(nullable)}  # presence bits, 62 per word
    words = sorted({w for w, _ in bit.values()})
    present = {m: F.col(w).bitwiseAND(F.lit(1 << b)) != 0 for m, (w, b) in bit.items()}
    mask = {k: (k if k in bit else None) for k in range(p)}
    specs, spec_of = [], {}
    for a in range(p):
        for b in range(p):
            sp = (a, mask[b])
            if a != b and sp not in spec_of:
                spec_of[sp] = len(specs)
                specs.append(sp)

    word_exprs = []
    for w in words:
        e = F.lit(0).cast("bigint")
        for m, (ww, b) in bit.items():
            if ww == w:
                e = e.bitwiseOR(F.when(F.col(f"_x{m}").isNotNull(), F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint"))
        word_exprs.append(e.alias(w))
    stacked = fixed.select("_rid", *word_exprs, F.explode(F.array(*[
        F.struct(F.lit(k).alias("s"), F.col(f"_x{k}").alias("v")) for k in range(p)])).alias("e")) \
        .select("_rid", *words, "e.s", "e.v").filter(F.col("v").isNotNull())
    cells = ordered_cells(stacked, "v", ["s"], buckets=buckets,
                          extra_sums={f"_c{m}": F.when(present[m], 1).otherwise(0).cast("bigint") for m in nullable})
    lookup = cells.select("s", "v", (F.col("before") + (F.col("cnt") + 1) / 2.0).alias("_rall"),
                          *[(F.col(f"_c{m}_before") + (F.col(f"_c{m}") + 1) / 2.0).alias(f"_q{m}") for m in nullable])
    few = [k for k in range(p) if stats[f"_d{k}"] <= FEW_VALUES]
    many = [k for k in range(p) if k not in few]
    wide = fixed.select("_rid", *word_exprs, *[f"_x{k}" for k in few])
    ranks = []
    for k in few:
        of = [(si, m) for si, (a, m) in enumerate(specs) if a == k]
        table = lookup.where(F.col("s") == k).select(F.col("v").alias(f"_l{k}"), *[
            F.col("_rall" if m is None else f"_q{m}").alias(f"_t{si}") for si, m in of])
        wide = wide.join(F.broadcast(table), F.col(f"_x{k}") == F.col(f"_l{k}"), "left")
        ranks += [(F.col(f"_t{si}") if m is None else F.when(present[m], F.col(f"_t{si}"))).alias(f"_r{si}") for si, m in of]
    wide = wide.select("_rid", *ranks)
    if many:
        def rank_of(a, m):
            return F.col("_rall") if m is None else F.when(present[m], F.col(f"_q{m}"))
        of_many = F.col("s").isin(many)
        ranked = stacked.where(of_many).join(lookup.where(of_many), ["s", "v"])
        ranked = ranked.groupBy("_rid").agg(*[F.max(F.when(F.col("s") == a, rank_of(a, m))).alias(f"_r{si}")
                                              for si, (a, m) in enumerate(specs) if a in many])
        wide = wide.join(ranked, "_rid", "left") if few else ranked
    rcols = [f"_r{s}" for s in range(len(specs))]
    # pair (a, b) reads corr(R[a|b], R[b|a]): p (p - 1) / 2 of the pairs of rank columns
    rows = [(spec_of[(a, mask[b])], spec_of[(b, mask[a])], a, b) for a in range(p) for b in range(a + 1, p)]
    rm = pair_moments(wide.select(rcols), rcols, [r[:2] for r in rows])
    want = df.sparkSession.createDataFrame(rows, "si int, sj int, i int, j int")
    rm = rm.select(F.col("i").alias("si"), F.col("j").alias("sj"), _r_from_moments().alias("r"), "n")
    upper = want.join(F.broadcast(rm), ["si", "sj"], "left").select("i", "j", "r", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    diag = df.sparkSession.createDataFrame(
        [(k, k, 1.0 if stats[f"_v{k}"] and stats[f"_n{k}"] >= 2 else None, int(stats[f"_n{k}"])) for k in range(p)],
        "i int, j int, r double, n bigint")
    return _mirror(upper.unionByName(diag), cols)


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """C1/C2/C3 dispatcher."""
    if method == "pearson":
        return pearson_matrix(df, cols)
    if method == "spearman":
        return spearman_matrix(df, cols)
    if method == "kendall":
        from featlens.operators.kendall import kendall_matrix
        return kendall_matrix(df, cols)
    raise ValueError(f"unknown correlation method {method!r}")


# ---------------------------------------------------------------- matrix consumers

def _abs_desc(c: str = "r") -> list[Column]:
    return [F.abs(F.col(c)).desc_nulls_last()]


def target_correlations(corr: DataFrame, target: str, keep_self: bool = False) -> DataFrame:
    """``(feature, r, rank)`` of every feature with the target, |r| desc, nulls last.

    Ties keep column order. The window spans at most p rows.
    """
    t = corr.filter(F.col("f2") == target)
    if not keep_self:
        t = t.filter(F.col("f1") != target)
    w = Window.orderBy(*_abs_desc(), F.col("i"))
    return t.select(F.col("f1").alias("feature"), F.col("i").alias("pos"), "r",
                    F.row_number().over(w).cast("bigint").alias("rank"))


def top_k(df: DataFrame, k: int, order_col: str = "rank") -> DataFrame:
    """First ``k`` rows of an ordered feature-level table."""
    return df.orderBy(order_col).limit(k)


def multicollinear_pairs(corr: DataFrame, target: str, threshold: float = 0.85) -> DataFrame:
    """Upper-triangle feature pairs with |r| > threshold (target excluded)."""
    return (corr.filter((F.col("i") < F.col("j")) & (F.col("f1") != target) & (F.col("f2") != target)
                        & (F.abs("r") > threshold))
            .select(F.col("f1").alias("feature1"), F.col("f2").alias("feature2"), "r", "i", "j"))


def suggest_pairs(corr: DataFrame, target: str, min_correlation: float = 0.15,
                  max_correlation: float = 0.85, top_n: int = 20) -> DataFrame:
    """Complementary pairs among features with |r_t| >= min, pair |r| <= max.

    score = (|r_at| + |r_bt|) * (1 - |r_ab| / max); score desc, ties in candidate order;
    the first member is the one with the higher |r_t|.
    """
    if max_correlation <= 0:
        raise ValueError("max_correlation must be > 0")
    tv = target_correlations(corr, target).filter(F.abs("r") >= min_correlation)
    a = tv.select(F.col("feature").alias("feature1"), F.col("rank").alias("rank1"), F.col("r").alias("r1"))
    b = tv.select(F.col("feature").alias("feature2"), F.col("rank").alias("rank2"), F.col("r").alias("r2"))
    m = corr.select(F.col("f1").alias("feature1"), F.col("f2").alias("feature2"), F.col("r").alias("pair_r"))
    # candidates are feature-level (<= p rows): the theta join is p^2 at most.
    cand = a.join(b, F.col("rank1") < F.col("rank2")).join(m, ["feature1", "feature2"])
    scored = (cand.filter(F.abs("pair_r") <= max_correlation)
              .withColumn("score", (F.abs("r1") + F.abs("r2")) * (1 - F.abs("pair_r") / max_correlation)))
    w = Window.orderBy(F.col("score").desc(), "rank1", "rank2")
    return (scored.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= top_n)
            .select("rank", "feature1", "feature2", "score", "r1", "r2", "pair_r"))


def enrich_pairs(pairs: DataFrame, corr: DataFrame, target: str) -> DataFrame:
    """Attach both target correlations and the pair correlation."""
    tv = corr.filter(F.col("f2") == target).select(F.col("f1").alias("_f"), F.col("r").alias("_rt"))
    m = corr.select(F.col("f1").alias("feature1"), F.col("f2").alias("feature2"), F.col("r").alias("pair_r"))
    base = pairs.drop("r1", "r2", "pair_r")
    return (base.join(tv.withColumnRenamed("_f", "feature1").withColumnRenamed("_rt", "r1"), "feature1", "left")
            .join(tv.withColumnRenamed("_f", "feature2").withColumnRenamed("_rt", "r2"), "feature2", "left")
            .join(m, ["feature1", "feature2"], "left"))


def lower_triangle(corr: DataFrame, first: int | None = None) -> DataFrame:
    """C11: i >= j cells, optionally only the first ``first`` columns."""
    out = corr.filter(F.col("i") >= F.col("j"))
    if first is not None:
        out = out.filter((F.col("i") < first) & (F.col("j") < first))
    return out


def target_column(corr: DataFrame, target: str, n: int = 15) -> DataFrame:
    """Target column including self (1.0), |r| desc, first ``n``."""
    return target_correlations(corr, target, keep_self=True).filter(F.col("rank") <= n)


def top_pairs(corr: DataFrame, target: str, n: int = 10) -> DataFrame:
    """Strongest upper-triangle pairs, target excluded."""
    w = Window.orderBy(*_abs_desc(), "i", "j")
    return (corr.filter((F.col("i") < F.col("j")) & (F.col("f1") != target) & (F.col("f2") != target))
            .withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= n)
            .select("rank", F.col("f1").alias("feature1"), F.col("f2").alias("feature2"), "r"))


def pair_corr(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """C14: r of two (possibly derived) columns on their complete rows; NULL if constant."""
    d = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).dropna()
    return d.agg(F.count(F.lit(1)).alias("n"),
                 F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"))


def group_pairs(corr: DataFrame, left: list[str], right: list[str], min_abs: float = 0.3,
                n: int = 15) -> DataFrame:
    """(left, right) pairs with |r| > min_abs, |r| desc, first ``n``."""
    w = Window.orderBy(*_abs_desc(), "i", "j")
    return (corr.filter(F.col("f1").isin(left) & F.col("f2").isin(right) & (F.abs("r") > min_abs))
            .withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= n)
            .select("rank", F.col("f1").alias("left"), F.col("f2").alias("right"), "r"))


def corr_report(corr: DataFrame, target: str) -> DataFrame:
    """One-row report with default thresholds (0.85 / 0.15-0.85 / 20)."""
    tv = target_correlations(corr, target)
    top10 = tv.filter(F.col("rank") <= 10).agg(
        F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("rank", "feature", "r"))),
                                       lambda s: F.struct(s["feature"], s["r"]))).alias("top_correlations"))
    mc = multicollinear_pairs(corr, target, 0.85)
    sg = suggest_pairs(corr, target, 0.15, 0.85, 20)
    n_feat = tv.agg(F.count(F.lit(1)).alias("n_features"))
    return (n_feat.crossJoin(top10)
            .crossJoin(mc.agg(F.count(F.lit(1)).alias("n_multicollinear_pairs"),
                              F.sort_array(F.collect_list(F.struct("i", "j", "feature1", "feature2", "r")))
                              .alias("multicollinear_details")))
            .crossJoin(sg.agg(F.count(F.lit(1)).alias("n_suggested_interactions")))
            .withColumn("target", F.lit(target)))


def group_pairs_df(corr: DataFrame, left: DataFrame, right: DataFrame, min_abs: float = 0.3,
                   n: int = 15) -> DataFrame:
    """C15 with feature-level membership tables (``feature`` column) instead of lists."""
    w = Window.orderBy(*_abs_desc(), "i", "j")
    m = (corr.join(F.broadcast(left.select(F.col("feature").alias("f1"))), "f1")
         .join(F.broadcast(right.select(F.col("feature").alias("f2"))), "f2")
         .filter(F.abs("r") > min_abs))
    return (m.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)
            .select("rank", F.col("f1").alias("left"), F.col("f2").alias("right"), "r"))
