"""Feature engineering.

Derived columns are plain Spark expressions added with one ``withColumns`` so the whole
projection stays in one codegen stage. Data-dependent constants (medians, minima, bin
edges) are computed by one distributed aggregate and applied either lazily through a
one-row broadcast or, where the *schema* depends on them (skip/keep decisions), after
collecting a handful of per-feature scalars.
"""

from __future__ import annotations

import bisect
import warnings
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlens.functions.scalar import is_numeric_type, nan_to_null
from featlens.operators.quantiles import quantile_long
from featlens.operators.ranking import ordered_cells
from featlens.operators.selection import order_quantiles
from featlens.session import materialize

KINDS = ("multiply", "add", "divide", "subtract")


def interaction_names(a: str, b: str, kind: str) -> str:
    return {"multiply": f"{a}_X_{b}", "add": f"{a}_PLUS_{b}", "divide": f"{a}_DIV_{b}",
            "subtract": f"{a}_MINUS_{b}"}[kind]


@dataclass
class FeatureLog:
    """G18 bookkeeping: what was created, in creation order."""
    original: list[str]
    created: list[str] = field(default_factory=list)
    interactions: list[str] = field(default_factory=list)
    polynomials: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def create_interactions(df: DataFrame, pairs: list[tuple[str, str]], kind: str = "multiply",
                        original: list[str] | None = None, log: FeatureLog | None = None) -> DataFrame:
    """Products, sums, ratios, differences for each pair (``'all'`` = all four in order).

    Pairs naming a column absent from the *original* table are skipped (G6). Ratios: a zero
    denominator gives NULL, then every NULL ratio takes the ratio's median (one pipeline for
    all ratio columns).
    """
    kinds = KINDS if kind == "all" else (kind,)
    if kind != "all" and kind not in KINDS:
        raise ValueError(f"unknown interaction type {kind!r}")
    base = set(original if original is not None else df.columns)
    new: dict[str, Column] = {}
    ratios = []
    for a, b in pairs:
        if a not in base or b not in base:
            if log is not None:
                log.skipped.append(f"{a}*{b}")
            continue
        for k in kinds:
            name = interaction_names(a, b, k)
            x, y = nan_to_null(F.col(a).cast("double")), nan_to_null(F.col(b).cast("double"))
            if k == "multiply":
                new[name] = x * y
            elif k == "add":
                new[name] = x + y
            elif k == "subtract":
                new[name] = x - y
            else:
                new[name] = F.try_divide(x, F.when(y == 0, F.lit(None)).otherwise(y))
                ratios.append(name)
            if log is not None:
                log.created.append(name)
                log.interactions.append(name)
    out = df.withColumns(new) if new else df
    if ratios:
        med = quantile_long(out, ratios, [0.5]).groupBy().pivot("column", ratios).agg(F.first("value"))
        med = med.select([F.col(f"`{r}`").alias(f"_med_{k}") for k, r in enumerate(ratios)])
        cols = [F.coalesce(F.col(c), F.col(f"_med_{ratios.index(c)}")).alias(c) if c in ratios else F.col(c)
                for c in out.columns]
        out = out.crossJoin(F.broadcast(med)).select(cols)    # one-row broadcast
    return out


def create_polynomials(df: DataFrame, features: list[str], degree: int = 2,
                       original: list[str] | None = None, log: FeatureLog | None = None) -> DataFrame:
    """``A_POW2 .. A_POW{degree}``."""
    base = set(original if original is not None else df.columns)
    new = {}
    for f in features:
        if f not in base:
            continue
        for d in range(2, degree + 1):
            name = f"{f}_POW{d}"
            new[name] = F.pow(F.col(f).cast("double"), F.lit(float(d)))
            if log is not None:
                log.created.append(name)
                log.polynomials.append(name)
    return df.withColumns(new) if new else df


def create_custom(df: DataFrame, transforms: dict[str, Callable[[DataFrame], Column]],
                  log: FeatureLog | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Name -> function(table) -> Column. Analysis failures are reported and skipped."""
    out, failed = df, {}
    for name, fn in transforms.items():
        try:
            col = fn(out)
            out.select(col.alias(name)).schema     # analysis only, no job
            out = out.withColumn(name, col)
            if log is not None:
                log.created.append(name)
        except Exception as exc:  # noqa: BLE001 - reported, like the reference
            failed[name] = str(exc).splitlines()[0][:200]
    return out, failed


def cut(c: str | Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed intervals ``(e[k], e[k+1]]`` -> ``labels[k]``; outside -> NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges) - 1 labels")
    x = F.col(c) if isinstance(c, str) else c
    expr = None
    for k, lab in enumerate(labels):
        cond = (x > edges[k]) & (x <= edges[k + 1])
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def create_log_features(df: DataFrame, features: list[str], handle_negatives: str = "shift",
                        original: list[str] | None = None, log: FeatureLog | None = None) -> DataFrame:
    """``A_LOG = log1p(x')`` with x' = x - min + 1 if min <= 0 (shift), |x| (absolute);
    'skip' drops features holding any x <= 0."""
    if handle_negatives not in ("shift", "absolute", "skip"):
        raise ValueError(f"unknown handle_negatives {handle_negatives!r}")
    base = set(original if original is not None else df.columns)
    feats = [f for f in features if f in base]
    if not feats:
        return df
    mins = df.agg(*[F.min(F.col(f).cast("double")).alias(f"_min_{k}") for k, f in enumerate(feats)])
    new = {}
    if handle_negatives == "skip":
        row = mins.first()                       # one scalar per feature
        for k, f in enumerate(feats):
            if row[f"_min_{k}"] is not None and row[f"_min_{k}"] <= 0:
                if log is not None:
                    log.skipped.append(f"{f}_LOG")
                continue
            new[f"{f}_LOG"] = F.log1p(F.col(f).cast("double"))
        out = df.withColumns(new) if new else df
    elif handle_negatives == "absolute":
        new = {f"{f}_LOG": F.log1p(F.abs(F.col(f).cast("double"))) for f in feats}
        out = df.withColumns(new)
    else:
        joined = df.crossJoin(F.broadcast(mins))  # one-row broadcast
        for k, f in enumerate(feats):
            x, mn = F.col(f).cast("double"), F.col(f"_min_{k}")
            new[f"{f}_LOG"] = F.log1p(F.when(mn <= 0, x - mn + 1).otherwise(x))
        out = joined.withColumns(new).drop(*[f"_min_{k}" for k in range(len(feats))])
    if log is not None:
        log.created.extend(new)
    return out


# ---------------------------------------------------------------- binning

def _bin_checks(df: DataFrame, feats: list[str]) -> dict:
    """Per feature (has_null, min, max) from one aggregate."""
    aggs = []
    for k, f in enumerate(feats):
        x = F.col(f).cast("double")
        aggs += [F.count(F.when(x.isNull() | F.isnan(x), 1)).alias(f"_n{k}"),
                 F.min(x).alias(f"_lo{k}"), F.max(x).alias(f"_hi{k}")]
    row = df.agg(*aggs).first()
    return {f: (row[f"_n{k}"], row[f"_lo{k}"], row[f"_hi{k}"]) for k, f in enumerate(feats)}


def _bin_by_edges(x: Column, edges: list[float]) -> Column:
    """Ordinal bin = number of inner edges <= x (edges sorted, duplicates removed): comparisons in generated code."""
    kept = [e for i, e in enumerate(edges) if i == 0 or e - edges[i - 1] > 1e-8]
    bin_ = F.lit(0.0)
    for e in kept[1:-1]:
        bin_ = bin_ + F.when(x >= F.lit(e), 1.0).otherwise(0.0)
    return bin_


def create_binned_features(df: DataFrame, features: list[str], n_bins: int = 5, strategy: str = "quantile",
                           original: list[str] | None = None, log: FeatureLog | None = None,
                           kmeans_iter: int = 300) -> DataFrame:
    """Ordinal bins ``A_BIN{n}`` by quantile, uniform width or 1-D k-means edges.

    Features with missing values or a constant value are not created (reported in ``log``).
    """
    if strategy not in ("quantile", "uniform", "kmeans"):
        raise ValueError(f"unknown binning strategy {strategy!r}")
    base = set(original if original is not None else df.columns)
    feats = [f for f in features if f in base]
    checks = _bin_checks(df, feats) if feats else {}
    ok = []
    for f in feats:
        nulls, lo, hi = checks[f]
        if nulls or lo is None or lo == hi:
            if log is not None:
                log.skipped.append(f"{f}_BIN{n_bins}")
            continue
        ok.append(f)
    if not ok:
        return df
    edges = {}
    if strategy == "quantile":
        for f, _, value in order_quantiles(df, ok, [k / n_bins for k in range(n_bins + 1)]):
            edges.setdefault(f, []).append(value)
    elif strategy == "uniform":
        for f in ok:
            _, lo, hi = checks[f]
            edges[f] = [lo + (hi - lo) * i / n_bins for i in range(n_bins)] + [hi]
    else:
        edges = kmeans_edges_of(df, ok, n_bins, {f: checks[f][1:] for f in ok}, kmeans_iter)
    new = {f"{f}_BIN{n_bins}": _bin_by_edges(F.col(f).cast("double"), edges[f]) for f in ok}
    if log is not None:
        log.created.extend(new)
    return df.withColumns(new)


#: Stretches of a feature's sorted distinct values of which the driver knows the sums (a feature with fewer values: each one).
KMEANS_STRETCHES = 4096


def kmeans_edges_of(df: DataFrame, features: list[str], n_bins: int, bounds: dict[str, tuple[float, float]],
                    max_iter: int = 300, tol: float = 1e-4, stretches: int = KMEANS_STRETCHES) -> dict[str, list[float]]:
    """G15 for all features at once: Lloyd's rounds on sorted distinct values, centres first at the middles of
    ``n_bins`` uniform intervals; edges = [min, middles of the centres, max].

    One pass over the data writes, per feature, the distinct values with the running sums of their weights and of
    weight x value. A cluster is the stretch between two middles, so a round needs the running sums at
    ``n_bins - 1`` places. The sums at the start of every stretch of values are with the driver; a place inside a
    stretch is looked up in that stretch, for all features in one job. A value at a middle belongs to the lower centre;
    a centre without values stays. Rounds end when the centres move by ``tol`` times the variance or less
    (squared, in all); a warning is given if ``max_iter`` rounds don't suffice.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f).cast("double").alias("v")) for k, f in enumerate(features)])).alias("e")).select("e.f", "e.v")
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v"))
    cells = materialize(ordered_cells(long, "v", ["f"], extra_sums={"wv": F.col("v"), "wvv": F.col("v") * F.col("v")}))
    totals = {r["f"]: r for r in cells.groupBy("f").agg(F.sum("cnt").alias("w"), F.sum("wv").alias("wv"), F.sum("wvv").alias("wvv"), F.count(F.lit(1)).alias("m")).collect()}
    size = {k: -(-r["m"] // stretches) for k, r in totals.items()}
    length = F.lit(1)
    for k, n in size.items():
        length = F.when(F.col("f") == k, n).otherwise(length)
    placed = cells.withColumn("b", F.col("dense_before").cast("bigint") - F.pmod(F.col("dense_before"), length))
    index: dict[int, list] = {k: [] for k in totals}
    for r in placed.groupBy("f", "b").agg(F.min("v").alias("v"), F.min("before").alias("w"), F.min_by("wv_before", "v").alias("wv")).orderBy("f", "b").collect():
        index[r["f"]].append((r["v"], r["b"], float(r["w"]), float(r["wv"])))

    centers, eps = {}, {}
    for k, r in totals.items():
        lo, hi = map(float, bounds[features[k]])
        uni = [lo + (hi - lo) * i / n_bins for i in range(n_bins + 1)]
        centers[k] = [(uni[i] + uni[i + 1]) / 2 for i in range(n_bins)]
        eps[k] = tol * max(r["wvv"] / r["w"] - (r["wv"] / r["w"]) ** 2, 0.0)
    moving = set(centers)
    for _ in range(max_iter):
        if not moving:
            break
        middles = {k: [(a + b) / 2 for a, b in zip(centers[k], centers[k][1:])] for k in moving}
        sums = _running_sums(placed, index, size, totals, middles)
        for k in list(moving):
            ends = [(0.0, 0.0), *sums[k], (float(totals[k]["w"]), float(totals[k]["wv"]))]
            new = [(v1 - v0) / (w1 - w0) if w1 > w0 else c for (w0, v0), (w1, v1), c in zip(ends, ends[1:], centers[k])]
            shift = sum((x - y) ** 2 for x, y in zip(new, centers[k]))
            centers[k] = new
            if shift <= eps[k]:
                moving.discard(k)
    if moving:
        warnings.warn(f"k-means bins of {sorted(features[k] for k in moving)} still move after {max_iter} rounds", stacklevel=2)
    out = {}
    for k, f in enumerate(features):
        c = sorted(centers.get(k, []))
        out[f] = [float(bounds[f][0]), *[(a + b) / 2 for a, b in zip(c, c[1:])], float(bounds[f][1])]
    return out


def _running_sums(placed: DataFrame, index: dict, size: dict, totals: dict, places: dict[int, list[float]]) -> dict[int, list[tuple[float, float]]]:
    """Per feature and place: (weight, weight x value) of the values at or below it."""
    out = {k: [(0.0, 0.0)] * len(v) for k, v in places.items()}
    ask = []
    for k, values in places.items():
        starts = [r[0] for r in index[k]]
        for i, x in enumerate(values):
            at = bisect.bisect_right(starts, x)
            if at == 0:
                continue
            if size[k] == 1:        # every value is a stretch: the sums ahead of the next one
                out[k][i] = index[k][at][2:] if at < len(starts) else (float(totals[k]["w"]), float(totals[k]["wv"]))
            else:
                ask.append((k, i, index[k][at - 1][1], x))
    if ask:
        wanted = placed.sparkSession.createDataFrame(ask, "f int, i int, b bigint, x double")
        some = F.lit(False)         # reaches the scan
        for k, _, b, _ in ask:
            some = some | ((F.col("f") == k) & F.col("dense_before").between(b, b + size[k] - 1))
        hit = placed.where(some).join(F.broadcast(wanted), ["f", "b"]).where("v <= x")
        for r in hit.groupBy("f", "i").agg(F.max(F.col("before") + F.col("cnt")).alias("w"), F.max_by(F.col("wv_before") + F.col("wv"), "v").alias("wv")).collect():
            out[r["f"]][r["i"]] = (float(r["w"]), float(r["wv"]))
    return out


def kmeans_edges(df: DataFrame, feature: str, n_bins: int, lo: float, hi: float,
                 max_iter: int = 300, tol: float = 1e-4) -> list[float]:
    """G15 for one feature."""
    return kmeans_edges_of(df, [feature], n_bins, {feature: (lo, hi)}, max_iter, tol)[feature]


def quartile_labels(df: DataFrame, feature: str | list[str], labels=("Low", "Med-Low", "Med-High", "High"),
                    out_col: str | None = None) -> DataFrame:
    """``qcut(q=4)``: right-closed quartile bins, lowest value included, for one feature or several (``<feature>_bin``).

    With duplicate edges the remaining bins are labelled by position. The edges of all features are selected at once
    and compared as literals.
    """
    features = [feature] if isinstance(feature, str) else list(feature)
    edges: dict[str, list[float]] = {f: [] for f in features}
    for f, _, value in order_quantiles(df, features, [0.25, 0.5, 0.75]):
        edges[f].append(value)
    new = {}
    for f in features:
        x, cuts = F.col(f), [e for i, e in enumerate(edges[f]) if i == 0 or e > edges[f][i - 1]]
        k = F.lit(0)        # position of x among the distinct inner edges
        for e in cuts:
            k = k + F.when(x > F.lit(e), 1).otherwise(0)
        label = F.element_at(F.array(*[F.lit(s) for s in labels]), k + 1)
        new[out_col if out_col and len(features) == 1 else f"{f}_bin"] = F.when(x.isNotNull(), label)
    return df.withColumns(new)


def remove_low_variance(df: DataFrame, target: str | None, threshold: float = 0.01) -> DataFrame:
    """Drop numeric features whose population variance is <= threshold (target exempt,
    NULLs ignored). If no feature would survive, the table is returned unchanged."""
    feats = [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name != target]
    if not feats:
        return df
    row = df.agg(*[F.var_pop(nan_to_null(F.col(f).cast("double"))).alias(f"_v{k}") for k, f in enumerate(feats)]).first()
    keep = [f for k, f in enumerate(feats) if row[f"_v{k}"] is not None and row[f"_v{k}"] > threshold]
    if not keep:
        return df
    drop = [f for f in feats if f not in keep]
    return df.drop(*drop)


def feature_summary(spark, log: FeatureLog) -> DataFrame:
    """One row: counts and the created list (the list is not reduced by G17)."""
    return spark.createDataFrame(
        [(len(log.original), len(log.original) + len(log.created), len(log.created),
          len(log.interactions), len(log.polynomials), list(log.created))],
        "original_features bigint, total_features bigint, created_features bigint, "
        "interaction_features bigint, polynomial_features bigint, feature_list array<string>")
