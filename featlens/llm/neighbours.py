"""Approximate nearest neighbours (cosine) by collision counting on single projections.

Vectors are scaled to unit length. ``PROJECTIONS`` random lines are drawn once from a seed. Every block of
vectors keeps, for each line, its vectors sorted by their projection. A query looks at a window around its own
projection on every line and counts, per vector, in how many windows it lies. The windows grow by virtual
rehashing: each round widens the radius by ``GROWTH`` and counts the newly covered stretches only, until
``share`` of the block (and ``k`` at least) have collided on ``threshold`` of the lines. Those vectors are
verified by their exact cosine on the original vectors.

Every row is indexed and every query meets every block; nothing is sampled. Recall against brute force is
measured in the tests. Defined cases: see ``vectors``; zero vectors take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.llm import vectors as V
from featlens.session import materialize

K = 5
PROJECTIONS = 48
#: Vectors in a block: its sorted arrays stay in cache.
BLOCK_ROWS = 8192
#: Half widths of the windows: first, growth per round, last.
RADIUS, GROWTH, WIDEST = 0.6, 1.2, 8.0
#: Share of the lines that must collide, and share of a block that ends the rounds.
THRESHOLD, SHARE = 0.75, 0.15


def lines(dim: int, n: int = PROJECTIONS, seed: int = 5) -> np.ndarray:
    """``n`` random directions; each scaled so that a unit vector's projection has variance one, about."""
    return np.random.default_rng([seed, dim]).standard_normal((n, dim))


class Block:
    """The projection-sorted arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.matrix = ids, matrix
        self.norm = np.sqrt((matrix * matrix).sum(1))
        self.unit = matrix / self.norm[:, None]
        self.lines = lines(matrix.shape[1], projections)
        at = (self.unit @ self.lines.T).T
        self.order = np.argsort(at, axis=1, kind="stable")
        self.at = np.take_along_axis(at, self.order, axis=1)

    def windows(self, own: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Ends of the windows in the sorted arrays: (query, radius, line, low or high)."""
        q, m = own.shape
        out = np.empty((q, len(radii), m, 2), np.int64)
        for j in range(m):
            out[:, :, j, 0] = np.searchsorted(self.at[j], own[:, j, None] - radii)
            out[:, :, j, 1] = np.searchsorted(self.at[j], own[:, j, None] + radii, side="right")
        return out

    def candidates(self, ends: np.ndarray, least: int, threshold: int) -> np.ndarray:
        """Positions that collide with a query on at least ``threshold`` lines, at the first radius with ``least`` of them."""
        counts = np.zeros(len(self.ids), np.int64)
        before = None
        for now in ends.tolist():
            if before is None:
                fresh = [line[lo:hi] for line, (lo, hi) in zip(self.order, now)]
            else:  # the newly covered stretches on both sides
                fresh = [line[lo:old] for line, (lo, _), (old, _) in zip(self.order, now, before)]
                fresh += [line[old:hi] for line, (_, hi), (_, old) in zip(self.order, now, before)]
            counts += np.bincount(np.concatenate(fresh), minlength=len(counts))
            found = np.flatnonzero(counts >= threshold)
            if len(found) >= least:
                return found
            before = now
        return np.arange(len(counts))  # beyond the widest windows: everything

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, share: float = SHARE, threshold: float = THRESHOLD):
        """(query position, block positions, cosines), the ``k`` best verified candidates of each query."""
        q_norm = np.sqrt((q * q).sum(1))
        own = (q / q_norm[:, None]) @ self.lines.T
        least = min(len(self.ids), max(k + 1, int(np.ceil(share * len(self.ids)))))
        radii = RADIUS * GROWTH ** np.arange(int(np.ceil(np.log(WIDEST / RADIUS) / np.log(GROWTH))) + 1)
        for lo in range(0, len(q), 64):
            for i, ends in enumerate(self.windows(own[lo:lo + 64], radii), lo):
                pos = self.candidates(ends, least, int(np.ceil(threshold * len(self.lines))))
                pos = pos[self.ids[pos] != q_ids[i]]
                score = (self.matrix[pos] @ q[i]) / (self.norm[pos] * q_norm[i])
                best = V.local_best(score, self.ids[pos], k)
                yield i, pos[best], score[best]


def search(df: DataFrame, k: int = K, every: int = V.QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest vectors found for each query (``vec_id % every = 0``)."""
    d = V.usable(df).where(F.exists("v", lambda x: x != 0))
    blocks = materialize(V.blocks(d, BLOCK_ROWS))
    queries = materialize(V.blocks(d.where(F.pmod("vec_id", F.lit(every)) == 0), V.QUERY_ROWS))

    def run(batches):
        for b in batches:
            block, last = None, None
            for i, x in enumerate(b.column(0)):
                ids, m = V.unpack(b, i, x.as_py(), "ids", "matrix")
                if block is None or last != (x.as_py(), len(ids), int(ids[0])):
                    block, last = Block(ids, m), (x.as_py(), len(ids), int(ids[0]))
                q_ids, q = V.unpack(b, i, x.as_py(), "q_ids", "q_matrix")
                a, c, s = [], [], []
                for j, pos, score in block.search(q_ids, q, k):
                    a.extend([int(q_ids[j])] * len(pos))
                    c.extend(ids[pos].tolist())
                    s.extend(score.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])
    pairs = V.against(queries, blocks).select("dim", "ids", "matrix", "q_ids", "q_matrix")
    return V.ranked(pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double"), k, F.col("score"))
