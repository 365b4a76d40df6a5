"""N-gram Jaccard join: rare-first prefix filtering, and connected groups of similar documents.

A document is its set of word n-grams (64-bit hashes). All documents agree on an order of the n-grams, rarest
first; two sets with a Jaccard similarity of at least ``t`` then share an n-gram within the first
``|x| - ceil(t |x|) + 1`` of each. Only these prefixes are joined, under the length and positional filters;
a pair that is left passes the suffix filter (a lower bound of the difference from counts per hash range)
and is verified once, on the whole sets.

The order comes from counts over all documents in a table of ``BUCKETS`` hashed cells: its size is fixed, so
that it can be broadcast; a cell shared by several n-grams only makes the order less sharp, never the
result. Equal sets are one class, with its smallest doc_id as representative. In a group of documents that
share a prefix n-gram, all are first verified against one hub (the one that meets the n-gram earliest, that
is, with the fewest rare n-grams); connected components are taken; then only pairs of documents of
different components are verified, so a group of thousands of near copies costs about one pair a copy.

Defined cases: a document with fewer words than ``n`` has its whole sequence as its only n-gram; null or
empty texts and texts without words have none and are linked with nothing; rows with the same doc_id are
one document whose links are united; rows without a doc_id are linked with nothing, their component is
null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlens.llm.common import WordHashes, components, mix64, shingles, signed, texts
from featlens.session import materialize, owned_tables

BUCKETS = 1 << 20
_CELLS = 1 << 14  # cells in a row when the table is added up
_RANGES = 16  # hash ranges of the suffix filter
_BATCH = 1000  # texts or pairs of sets that a task's Python function has at once: a row can be long
_SET_BYTES = 4 << 20  # of the sets in one batch made, but for the last one


def _distinct(grams: np.ndarray) -> np.ndarray:
    s = np.sort(grams)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def _sets(hashes: WordHashes, text: bytes | None, n: int) -> np.ndarray:
    return _distinct(shingles(hashes.of(text), n))


def _each(hashes: WordHashes, batch: pa.RecordBatch, n: int) -> Iterator[np.ndarray]:
    """The set of each text of a batch."""
    return map(_distinct, hashes.shingles(texts(batch), n))


def _describe(n: int):
    """doc_id, size and digest of each set; at the end of a partition, its part of the table of counts."""
    def run(batches):
        hashes, counts, kind = WordHashes(), np.zeros(BUCKETS, np.int64), None
        names = ["doc_id", "n", "digest", "block", "counts"]
        for batch in batches:
            kind = batch.schema.field(0).type
            sizes, digests = [], []
            for s in _each(hashes, batch, n):
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s) > BUCKETS // 8:
                    counts += np.bincount((s >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
                else:
                    np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)
            m = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                              pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        used = [b for b in range(BUCKETS // _CELLS) if counts[b * _CELLS:(b + 1) * _CELLS].any()]
        if used:
            m = len(used)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(used, pa.int32()),
                                              pa.array([counts[b * _CELLS:(b + 1) * _CELLS].astype("<u4").tobytes() for b in used], pa.binary())], names)
    return run


def _add_up(batches):
    """Sums of the parts of the table that came to this task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, c in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[b] = total.get(b, 0) + np.frombuffer(c.as_buffer(), "<u4").astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())],
                                     ["block", "counts"])


def _order(described: DataFrame) -> np.ndarray:
    """The table of counts: BUCKETS numbers whatever the input."""
    parts = described.where("block is not null").select("block", "counts").repartition("block").mapInArrow(_add_up, "block int, counts binary")
    table = np.zeros(BUCKETS, np.int64)
    for r in materialize(parts).collect():  # the shuffle of the parts goes with the write
        table[r.block * _CELLS:(r.block + 1) * _CELLS] = np.frombuffer(bytes(r.counts), "<i8")
    return np.minimum(table, np.iinfo(np.uint32).max).astype(np.uint32)


def _prefixes(n: int, percent: int, order):
    """token, doc_id, pos, n: the n-grams of each prefix."""
    def run(batches):
        hashes, table = WordHashes(), order.value
        for batch in batches:
            who, token, pos, size, k = [], [], [], [], 0
            ids = batch.column(0)
            for i, s in enumerate(_each(hashes, batch, n)):
                if not len(s):
                    continue
                # by count and then hash: the set is in the order of its hashes
                rare = table[(s >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | np.arange(len(s), dtype=np.uint64)
                first = (np.sort(rare) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:len(s) - -(-percent * len(s) // 100) + 1]
                who.append(np.full(len(first), i))
                token.append(s[first])
                pos.append(np.arange(len(first), dtype=np.int32))
                size.append(np.full(len(first), len(s), np.int32))
                k += len(first)
                if k > 200_000:
                    yield _rows(ids, who, token, pos, size)
                    who, token, pos, size, k = [], [], [], [], 0
            if k:
                yield _rows(ids, who, token, pos, size)
    return run


def _rows(ids, who, token, pos, size):
    return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(token))), ids.take(pa.array(np.concatenate(who))),
                                       pa.array(np.concatenate(pos)), pa.array(np.concatenate(size))], ["token", "doc_id", "pos", "n"])


def _whole(n: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            held, size, done = [], 0, 0
            for s in _each(hashes, batch, n):
                held.append(s.tobytes())
                size += len(held[-1])
                if size > _SET_BYTES:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(held)), pa.array(held, pa.binary())], ["doc_id", "grams"])
                    held, size, done = [], 0, done + len(held)
            if held:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done), pa.array(held, pa.binary())], ["doc_id", "grams"])
    return run


def overlaps(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether ``100 |x & y| >= percent |x | y|`` for two sorted sets of hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    # suffix filter: what the counts per range differ by, the sets differ by at least
    most = (100 - percent) * (len(x) + len(y)) // (100 + percent)
    cx, cy = (np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=_RANGES) for s in (x, y))
    if np.abs(cx - cy).sum() > most:
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            ok = [overlaps(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent)
                  for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _possible(i: str, x: str, j: str, y: str, percent: int) -> Column:
    """Length filter and positional filter: n-gram number ``i`` of ``x`` is number ``j`` of ``y`` and their first common one."""
    return F.expr(f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y}) AND "
                  f"{100 + percent} * least({x} - {i}, {y} - {j}) >= {percent} * ({x} + {y})")


def links(docs: DataFrame, n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(described documents: doc_id, n, digest, rep; verified links a, b between representatives of classes, and between
    a doc_id with several texts and the representatives of these).

    The links connect the same documents as all links together would.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = materialize(d.mapInArrow(_describe(n), f"doc_id {kind}, n bigint, digest binary, block int, counts binary"), _BATCH)
    order = spark.sparkContext.broadcast(_order(described))
    every = described.where("digest is not null").select("doc_id", "n", "digest")
    classes = materialize(every.where("n > 0").groupBy(F.col("digest").alias("c_digest")).agg(F.min("doc_id").alias("rep")))
    every = every.join(classes, every.digest == classes.c_digest, "left").drop("c_digest")
    # rep <= doc_id: copies are the documents that represent none of their texts; several texts of one doc_id tie their classes
    known = every.where("n > 0 and doc_id is not null")
    held = materialize(known.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < doc_id"))
    copies = held.where("hi < doc_id")
    several = held.where("lo < hi").select(F.col("doc_id").alias("d_"))
    ties = materialize(known.where("rep < doc_id").join(several, F.col("doc_id") == F.col("d_")).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())

    # prefixes by n-gram; the n-grams that one document only has are dropped before anything is joined
    entries = d.where("doc_id is not null").mapInArrow(_prefixes(n, percent, order), f"token bigint, doc_id {kind}, pos int, n int")
    groups = entries.groupBy("token").agg(F.min(F.struct("pos", "n", "doc_id")).alias("hub"), F.max("doc_id").alias("last"), F.min("doc_id").alias("one"))
    groups = materialize(groups.where("one <> last").select(F.col("token").alias("t_"), "hub"), _BATCH)
    entries = entries.join(groups, entries.token == groups.t_).drop("t_")
    entries = entries.join(copies.select(F.col("doc_id").alias("copy")), F.col("doc_id") == F.col("copy"), "left_anti")
    entries = materialize(entries.select("token", "doc_id", "pos", "n", F.col("hub.doc_id").alias("hub"), F.col("hub.pos").alias("h_pos"), F.col("hub.n").alias("h_n")), _BATCH)

    ids = entries.select("doc_id").distinct()
    sets = d.join(ids, "doc_id", "left_semi").mapInArrow(_whole(n), f"doc_id {kind}, grams binary")
    sets = materialize(sets, _BATCH)

    def verified(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("doc_id").alias("x_"), F.col("grams").alias("x"))
        y = sets.select(F.col("doc_id").alias("y_"), F.col("grams").alias("y"))
        both = pairs.join(x, F.col("a") == F.col("x_")).drop("x_").join(y, F.col("b") == F.col("y_")).select("a", "b", "x", "y")
        return materialize(both.mapInArrow(_verify(percent), f"a {kind}, b {kind}"), _BATCH)

    def pair(p: str, q: str) -> list[Column]:
        return [F.least(p, q).alias("a"), F.greatest(p, q).alias("b")]

    tried = entries.where((F.col("doc_id") != F.col("hub")) & _possible("pos", "n", "h_pos", "h_n", percent))
    tried = materialize(tried.select(*pair("doc_id", "hub")).distinct())
    found = verified(tried).union(ties)
    linked = components(found)

    # what is left: pairs of different components that share a prefix n-gram
    at = linked.select(F.col("node").alias("n_"), F.col("component").alias("c_"))
    e = entries.join(at, entries.doc_id == at.n_, "left").withColumn("c", F.coalesce("c_", "doc_id")).drop("n_", "c_")
    e = e.join(at, e.hub == at.n_, "left").withColumn("h_c", F.coalesce("c_", "hub")).drop("n_", "c_")
    apart = materialize(e.select("token", "doc_id", "pos", "n", "c", "h_c"))
    odd = apart.where("c <> h_c").select(F.col("token").alias("o_token"), F.col("doc_id").alias("o_doc"), F.col("pos").alias("o_pos"),
                                         F.col("n").alias("o_n"), F.col("c").alias("o_c"))
    rest = odd.join(apart, (F.col("o_token") == F.col("token")) & (F.col("o_c") != F.col("c")) & _possible("o_pos", "o_n", "pos", "n", percent))
    rest = rest.select(*pair("o_doc", "doc_id")).distinct()
    rest = rest.join(tried.select(F.col("a").alias("a_"), F.col("b").alias("b_")), (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")), "left_anti")
    more = verified(rest)
    return every, found.union(more)


def groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    with owned_tables(docs.sparkSession) as owned:  # of the tables on the way none outlives the result
        every, linked = links(docs, n, percent)
        at = components(linked).select(F.col("node").alias("n_"), "component")
        out = every.join(at, every.rep == at.n_, "left")
        return owned.keep(out.select("doc_id", F.col("n").alias("n_shingles"),
                                     F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (same columns) whose doc_id is the smallest of its group; rows without a doc_id or without n-grams all stay.

    Of rows with the same doc_id, all stay or none: they are one document, so one text's link lets its other texts go too.
    """
    with owned_tables(docs.sparkSession) as owned:
        drop = groups(docs, n, percent).where("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("d_")).distinct()
        drop = owned.keep(drop)
    return docs.join(drop, F.col("doc_id") == F.col("d_"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
