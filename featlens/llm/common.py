"""Helpers shared by the text operators: reading tables, byte words, 64-bit hashes, components.

Words are what ``bytes.split()`` yields: maximal runs outside ``\\x20\\x09-\\x0D``; lower-casing
is ``bytes.lower()``, which touches only A-Z.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlens.session import materialize

#: A text longer than this is hashed in pieces cut at white space, so that the list of its words stays small.
PIECE_BYTES = 1 << 20
#: Bytes of short texts that are hashed at once: arrays that fit into a core's cache.
TOGETHER_BYTES = 200_000
_SPACE = b" \t\n\r\x0b\x0c"
_GAP = np.isin(np.arange(256), list(_SPACE))
#: What the hash mixes into words of 1-3, 4-8 and 9-16 bytes (its fixed key, taken together; seed 0).
_FLIP = np.array([0x87275A9B, 0xC73AB174C5ECD5A2, 0x6782737BEA4239B9, 0xAF56BC3B0996523A], np.uint64)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_id(doc_id="doc_id"):
    """``crc32`` of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``text`` in pieces of about ``size`` bytes that end where a word ends."""
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + size)
        while end < n and text[end] not in _SPACE:
            end += 1
        yield text[at:end]
        at = end


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The two halves of the 128-bit products, xored."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    xl, xh, yl, yh = x & low, x >> half, y & low, y >> half
    ll, hl, lh, hh = xl * yl, xh * yl, xl * yh, xh * yh
    c = (ll >> half) + (hl & low) + lh
    return ((hl >> half) + (c >> half) + hh) ^ ((c << half) | (ll & low))


def hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``text`` begins, and its ``xxh3_64``: words of up to 16 bytes all at once, longer ones by the library."""
    u = np.uint64
    raw = b"\0" * 8 + text + b"\0" * 8
    gap = np.ones(len(text) + 2, bool)
    np.take(_GAP, np.frombuffer(text, np.uint8), out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    n = end - start
    eight = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))  # the eight bytes from each place on
    first, last, size = eight[start + 8], eight[end], n.astype(np.uint64)
    out = np.empty(len(n), np.uint64)
    k = np.flatnonzero(n <= 3)
    f, s = first[k], size[k]
    h = (f & u(255)) << u(16) | (f >> (s >> u(1) << u(3)) & u(255)) << u(24) | last[k] >> u(56) | s << u(8)
    h ^= _FLIP[0]
    h = (h ^ h >> u(33)) * u(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> u(29)) * u(0x165667B19E3779F9)
    out[k] = h ^ h >> u(32)
    k = np.flatnonzero((n > 3) & (n <= 8))
    h = ((first[k] << u(32)) + (last[k] >> u(32))) ^ _FLIP[1]
    h = (h ^ _rotl(h, 49) ^ _rotl(h, 24)) * u(0x9FB21C651E98DF25)
    h = (h ^ ((h >> u(35)) + size[k])) * u(0x9FB21C651E98DF25)
    out[k] = h ^ h >> u(28)
    k = np.flatnonzero((n > 8) & (n <= 16))
    x, y = first[k] ^ _FLIP[2], last[k] ^ _FLIP[3]
    h = size[k] + x.byteswap() + y + _fold(x, y)
    h = (h ^ h >> u(37)) * u(0x165667919E3779F9)
    out[k] = h ^ h >> u(32)
    for i in np.flatnonzero(n > 16).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[start[i]:end[i]])
    return start, out


class WordHashes:
    """Words as 64-bit hashes, in order, A-Z lower-cased (null: none)."""

    def of(self, text: bytes | None) -> np.ndarray:
        return next(self.blocks([text]))[0]

    def blocks(self, many: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, words of each text) of consecutive texts, some ``TOGETHER_BYTES`` at a time."""
        held, n = [], 0
        for t in many:
            if held and n + len(t or b"") > TOGETHER_BYTES:
                yield self._block(held)
                held, n = [], 0
            held.append(t or b"")
            n += len(held[-1])
        if held:
            yield self._block(held)

    def _block(self, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(held) == 1:
            parts = [hashed_words(p)[1] for p in pieces(held[0].lower())]
            out = parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])
            return out, np.array([len(out)])
        start, out = hashed_words(b" ".join(held).lower())
        ends = np.cumsum([len(t) + 1 for t in held])
        return out, np.diff(np.searchsorted(start, ends), prepend=0)

    def shingles(self, many: Iterable[bytes | None], n: int) -> Iterator[np.ndarray]:
        """``shingles`` of the words of each text."""
        for words, sizes in self.blocks(many):
            grams, at = shingles(words, n), 0
            for k in sizes.tolist():  # those that begin in one text and end in another are left out
                yield grams[at:at + k - n + 1] if k >= n else shingles(words[at:at + k], n)
                at += k


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; of the whole sequence if there are fewer; nothing for no words."""
    if not len(words):
        return words
    k = min(n, len(words))
    acc = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        acc = (acc + words[i:len(words) - k + 1 + i]) * _MULT
        acc ^= acc >> np.uint64(32)
    return mix64(acc)


def texts(batch, column: str = "text") -> Iterator[bytes | None]:
    """The values of a string column of an Arrow batch as UTF-8 bytes, one at a time."""
    import pyarrow as pa
    col = batch.column(batch.schema.get_field_index(column))
    for v in col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()):
        yield v.as_py()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``links``; the component is its smallest reachable node.

    Each round gives every node the smallest label among its neighbours (a join on the neighbour, which
    adaptive execution may split, and a grouped minimum, partly taken before the exchange) and then the
    label of its label. Rounds are written to the shared checkpoint folder and end when no label
    changes. Links with a null end are ignored.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = materialize(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = materialize(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("c")))
    for _ in range(most_rounds):
        told = e.join(label, e.v == label.node).groupBy("u").agg(F.min("c").alias("m"))
        new = label.join(told, label.node == told.u, "left").select("node", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c"))
        up = label.select(F.col("node").alias("n_"), F.col("c").alias("c_"))
        new = new.join(up, new.c == up.n_, "left").select("node", F.least("c", F.coalesce("c_", "c")).alias("c"), "old")
        new = materialize(new)
        label = new.select("node", "c")
        if new.where("c <> old").limit(1).count() == 0:
            return label.select("node", F.col("c").alias("component"))
    raise RuntimeError(f"components: labels still change after {most_rounds} rounds")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int) -> DataFrame:
    """``(doc_id, text, y)`` for at most ``per_class`` labelled documents of each class, the same on every run.

    Rows whose ``crc32(doc_id) mod modulus`` is ``held`` are never used. Of the rest, the ids with the
    smallest hash are taken, class by class (a distributed top-k), so at most ``2 * per_class`` ids are
    broadcast. A repeated id counts once (its smaller label, its smaller text).
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (text_id() % modulus != held))
             .groupBy("doc_id").agg(F.min(label).cast("int").alias("y")))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    few = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    few = F.broadcast(few[0].union(few[1]))
    return (docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id")
            .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("y").alias("y")))


def class_counts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int) -> dict[int, int]:
    """How many labelled ids each class has, without the held-out ones."""
    rows = labels.where(F.col(label).isin(0, 1) & (text_id() % modulus != held)).groupBy(label).count().collect()
    return {0: 0, 1: 0} | {int(r[0]): r[1] for r in rows}


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500.0, 500.0)))
