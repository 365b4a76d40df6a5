"""Linear models, cross-validation, regularisation paths and PCA on moment blocks.

One scan turns every partition into centred moment blocks, one a fold: number of rows, means and the p x p
matrix of centred products, on rows without gaps. Blocks merge exactly, so the moments of "all folds but this"
are a merge of the others, and the error of a linear model on a fold is algebra on the fold's own block. What
reaches the driver is folds x p (p + 1) / 2 numbers, whatever the number of rows; every model, penalty and
fold is then fitted there on p x p matrices, without another scan.

Predictors are standardised by the training folds (mean, population deviation); a constant one gets no weight.
Elastic net: least of ``SSE / 2n + penalty * (mix * |b|_1 + (1 - mix) / 2 * |b|_2^2)`` over the weights ``b`` of the
standardised predictors; the intercept is free. ``mix`` 0 is ridge, 1 is lasso; ``penalty`` 0 is least squares, of least
norm where predictors depend on each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlens.session import materialize

_BLOCKS = "fold int, i int, j int, n bigint, mi double, mj double, c double"
_ARROW = pa.schema([("fold", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("mi", pa.float64()), ("mj", pa.float64()), ("c", pa.float64())])


@dataclass(frozen=True)
class Moments:
    """Rows, means and centred products of ``cols`` on the rows without gaps."""
    cols: tuple[str, ...]
    n: int
    mean: np.ndarray
    c: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(self.cols, n, self.mean + d * (other.n / n), self.c + other.c + np.outer(d, d) * (self.n * other.n / n))

    def only(self, cols) -> "Moments":
        at = [self.cols.index(c) for c in cols]
        return Moments(tuple(cols), self.n, self.mean[at], self.c[np.ix_(at, at)])


def _blocks(p: int):
    i, j = np.triu_indices(p)

    def run(batches):
        found: dict[int, Moments] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.asarray(batch.column(k + 1).to_numpy(zero_copy_only=False), np.float64) for k in range(p)])
            whole = ~np.isnan(x).any(axis=1)
            for f in np.unique(fold[whole]).tolist():
                rows = x[whole & (fold == f)]
                mean = rows.mean(axis=0)
                rows = rows - mean
                new = Moments((), len(rows), mean, rows.T @ rows)
                found[f] = found[f] + new if f in found else new
        for f, m in found.items():
            cols = [np.full(len(i), f), i, j, np.full(len(i), m.n), m.mean[i], m.mean[j], m.c[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(a, t.type) for a, t in zip(cols, _ARROW)], schema=_ARROW)
    return run


def fold_moments(df: DataFrame, cols: list[str], fold: Column | None = None, folds: int = 1) -> list[Moments]:
    """The moments of every fold 0 .. ``folds - 1`` (a fold without rows has ``n`` 0), from one scan."""
    p = len(cols)
    x = df.select((F.lit(0) if fold is None else fold).cast("int").alias("fold"), *[F.col(f"`{c}`").cast("double").alias(f"_x{k}") for k, c in enumerate(cols)])
    part = materialize(x.mapInArrow(_blocks(p), _BLOCKS))       # partitions x folds x p (p + 1) / 2 rows
    mean = part.groupBy("fold", "i", "j").agg(F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("mi")) / F.sum("n")).alias("gi"),
                                              (F.sum(F.col("n") * F.col("mj")) / F.sum("n")).alias("gj"))
    apart = F.col("n") * (F.col("mi") - F.col("gi")) * (F.col("mj") - F.col("gj"))
    merged = part.join(F.broadcast(mean), ["fold", "i", "j"]).groupBy("fold", "i", "j").agg(
        F.first("rows").alias("n"), F.first("gi").alias("gi"), F.first("gj").alias("gj"), F.sum(F.col("c") + apart).alias("c"))
    out = [[0, np.zeros(p), np.zeros((p, p))] for _ in range(folds)]
    for r in merged.collect():
        block = out[r["fold"]]
        block[0] = r["n"]
        block[1][r["i"]], block[1][r["j"]] = r["gi"], r["gj"]
        block[2][r["i"], r["j"]] = block[2][r["j"], r["i"]] = r["c"]
    return [Moments(tuple(cols), n, m, c) for n, m, c in out]


# ---------------------------------------------------------------- linear models on moments

@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    weights: np.ndarray         # of the columns as they are
    intercept: float

    def errors(self, m: Moments, target: str) -> tuple[float, float]:
        """(R^2, RMSE) on the rows of ``m``; R^2 is NaN where the target doesn't vary."""
        m = m.only([*self.features, target])
        if not m.n:
            return float("nan"), float("nan")
        w, cxx, cxy, cyy = self.weights, m.c[:-1, :-1], m.c[:-1, -1], m.c[-1, -1]
        off = m.mean[-1] - self.intercept - w @ m.mean[:-1]
        sse = max(0.0, cyy - 2 * w @ cxy + w @ cxx @ w + m.n * off * off)
        return float(1 - sse / cyy) if cyy > 0 else float("nan"), float(np.sqrt(sse / m.n))

    def predict(self) -> Column:
        out = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.weights.tolist()):
            out = out + F.lit(w) * F.col(f"`{f}`")
        return out


def elastic_net(m: Moments, features: list[str], target: str, penalty: float = 0.0, mix: float = 0.0,
                most: int = 10_000, tolerance: float = 1e-12) -> LinearModel:
    """The model of least penalised error on the rows of ``m`` (see above)."""
    m = m.only([*features, target])
    sd = np.sqrt(np.maximum(np.diag(m.c)[:-1], 0) / max(m.n, 1))
    used = np.flatnonzero(sd > 1e-12 * (1 + np.abs(m.mean[:-1])))
    s = sd[used]
    r = m.c[np.ix_(used, used)] / max(m.n, 1) / np.outer(s, s)
    g = m.c[used, -1] / max(m.n, 1) / s
    l1, l2 = penalty * mix, penalty * (1 - mix)
    if l1 == 0:
        b = np.linalg.solve(r + l2 * np.eye(len(used)), g) if l2 else np.linalg.lstsq(r, g, rcond=1e-10)[0]
    else:
        b = _descent(r, g, l1, l2, most, tolerance)
    weights = np.zeros(len(features))
    weights[used] = b / s
    return LinearModel(tuple(features), weights, float(m.mean[-1] - weights @ m.mean[:-1]))


def _descent(r: np.ndarray, g: np.ndarray, l1: float, l2: float, most: int, tolerance: float) -> np.ndarray:
    """Coordinate descent; where the signs stay, the equations of the weights in use settle the rest at once."""
    b, signs = np.zeros(len(g)), None
    for _ in range(most):
        old = b.copy()
        for k in range(len(b)):
            pull = g[k] - r[k] @ b + r[k, k] * b[k]
            b[k] = np.sign(pull) * max(0.0, abs(pull) - l1) / (r[k, k] + l2)
        if np.abs(b - old).max(initial=0) <= tolerance * (1 + np.abs(b).max(initial=0)):
            return b
        if signs is not None and (np.sign(b) == signs).all():
            on = np.flatnonzero(b)
            a = r[np.ix_(on, on)] + l2 * np.eye(len(on))
            if len(on) and np.linalg.cond(a) < 1e10:
                exact = np.zeros(len(b))
                exact[on] = np.linalg.solve(a, g[on] - l1 * signs[on])
                pull = g - r @ exact - l2 * exact
                off = np.setdiff1d(np.arange(len(b)), on)
                if (np.sign(exact) == signs).all() and (np.abs(pull[off]) <= l1).all():
                    return exact
        signs = np.sign(b)
    return b


def _leave_one_out(blocks: list[Moments]):
    """(fold, training moments, held-out moments) of every fold with rows."""
    for f, held in enumerate(blocks):
        rest = [b for i, b in enumerate(blocks) if i != f and b.n]
        if held.n and rest:
            train = rest[0]
            for b in rest[1:]:
                train = train + b
            yield f, train, held


def cross_validate(blocks: list[Moments], target: str, models: dict[str, tuple[list[str], float, float]]) -> list[tuple]:
    """For every model ``name -> (features, penalty, mix)`` the fold rows and their mean and (population) deviation:
    ``(model, part, fold, n_train, n_test, r2, rmse)`` with part ``fold``, ``mean`` or ``std``. No scan: ``blocks`` has it all."""
    out = []
    for name, (features, penalty, mix) in models.items():
        scores = [(f, train.n, held.n, *elastic_net(train, features, target, penalty, mix).errors(held, target)) for f, train, held in _leave_one_out(blocks)]
        out += [(name, "fold", *s) for s in scores]
        if scores:
            values = np.array([s[3:] for s in scores])
            out += [(name, part, None, None, None, *map(float, how(values, axis=0))) for part, how in (("mean", np.mean), ("std", np.std))]
    return out


CV_SCHEMA = "model string, part string, fold int, n_train bigint, n_test bigint, r2 double, rmse double"


def cross_validated(df: DataFrame, key: str, target: str, models: dict[str, tuple[list[str], float, float]], k: int = 5, seed: int = 42) -> DataFrame:
    """D1/D9 as a table: all models on the same folds (by the hash of ``key``), from one scan of ``df``."""
    from featlens.operators.validate import fold_of
    cols = list(dict.fromkeys([f for features, _, _ in models.values() for f in features] + [target]))
    blocks = fold_moments(df, cols, fold_of(key, k, seed), k)
    return df.sparkSession.createDataFrame(cross_validate(blocks, target, models), CV_SCHEMA)


def regularisation_path(df: DataFrame, key: str, features: list[str], target: str, penalties=(0.1, 0.3, 1.0), mixes=(0.0, 0.5),
                        k: int = 3, seed: int = 42) -> DataFrame:
    """``penalty, mix, mean_r2, std_r2, rank``: every pair of the grid on the same folds, from one scan; rank 1 wins
    (largest mean, ties: the earlier pair of the grid)."""
    from featlens.operators.validate import fold_of
    grid = [(float(p), float(m)) for p in penalties for m in mixes]
    blocks = fold_moments(df, [*features, target], fold_of(key, k, seed), k)
    rows = cross_validate(blocks, target, {str(i): (features, p, m) for i, (p, m) in enumerate(grid)})
    mean, std = ({int(r[0]): r[5] for r in rows if r[1] == part} for part in ("mean", "std"))
    order = sorted(mean, key=lambda i: (np.isnan(mean[i]), -mean[i], i))
    found = [(*grid[i], mean[i], std[i], order.index(i) + 1) for i in sorted(mean)]
    return df.sparkSession.createDataFrame(found, "penalty double, mix double, mean_r2 double, std_r2 double, rank int")


# ---------------------------------------------------------------- PCA

@dataclass(frozen=True)
class PcaModel:
    """Principal components of (standardised) columns. Row ``k`` of ``loadings`` is component ``k``; its largest
    loading by amount (the first of equals) is positive."""
    cols: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    variances: np.ndarray
    total: float
    loadings: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """``df`` with the components as columns ``pc1 ..``, column expressions only; NULL where a column is missing."""
        new = {}
        for k, v in enumerate(self.loadings.tolist()):
            e = F.lit(0.0)
            for c, w, m, s in zip(self.cols, v, self.mean.tolist(), self.scale.tolist()):
                e = e + F.lit(w) * ((F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s))
            new[f"{prefix}{k + 1}"] = e
        return df.withColumns(new)

    def table(self, df: DataFrame) -> DataFrame:
        """``component, variance, share, column, loading``, one row a component and column."""
        rows = [(k + 1, float(v), float(v / self.total) if self.total else None, c, float(w))
                for k, v in enumerate(self.variances) for c, w in zip(self.cols, self.loadings[k])]
        return df.sparkSession.createDataFrame(rows, "component int, variance double, share double, column string, loading double")


def pca(df: DataFrame, cols: list[str], k: int, standardise: bool = True) -> PcaModel:
    """The ``k`` first principal components of ``cols`` on the rows without gaps, from one scan."""
    m = fold_moments(df, cols)[0]
    cov = m.c / max(m.n, 1)
    sd = np.sqrt(np.diag(cov))
    scale = np.where(sd > 0, sd, 1.0) if standardise else np.ones(len(cols))
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(values)[::-1][:k]
    loadings = vectors[:, order].T.copy()
    for v in loadings:
        big = np.abs(v)
        v *= np.sign(v[np.flatnonzero(big >= big.max() - 1e-9)[0]]) or 1.0
    return PcaModel(tuple(cols), m.mean, scale, values[order], float(values.sum()), loadings)
