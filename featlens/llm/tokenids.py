"""Token ids in binary files: every document compressed on its own with one shared zstandard dictionary.

``write`` makes two Parquet tables below a path: ``dictionary`` (one row: hash, bytes) and ``blocks``. A
block holds the frames of consecutive documents back to back, the hash of the dictionary they need, and
an offset index (doc_id, offset, length, tokens), so that a short document can be read without touching
its neighbours. Documents are dealt out by a range of doc_id before they are tokenised, and sorted; part
and block numbers follow that order. Spark's commit protocol covers lost executors.

Defined cases: a null text is empty and has the end id only; null doc_ids come first; rows with the same
doc_id are kept, ordered by text; an empty table gives empty files.

The dictionary is trained on the id arrays of a bounded sample: the ``sample`` documents with the smallest
hash of their id. Everything else covers all documents.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from featlens.session import ensure_checkpoint_dir

END = 0
SAMPLE, DICTIONARY_BYTES, LEVEL = 512, 64 << 10, 3
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: Pieces that a worker remembers (results don't depend on it), and pieces that it hands over as one text.
_MOST_PIECES, _JOINED = 1_000_000, 1024
#: A space before a non-space always begins a new pre-token of a byte-level BPE, so a text may be cut there.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?=\s|\Z)")


class Tokenizer(dict):
    """``tokenizers`` on the distinct space-led pieces of the texts, remembered within a worker (``kept``).

    As a dictionary it numbers the pieces. New pieces are handed over many at a time. Those of a space and no other
    space follow one another as they would in a text: each begins a pre-token, and its first token, alone of its
    tokens, begins with the space. Between the others stands the special token: the library splits there first, so each
    piece is encoded as if it stood alone.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as T
        self.t = T.from_file(path)
        self.size = self.t.get_vocab_size(with_added_tokens=True)
        special = self.t.get_added_tokens_decoder()
        self.mark, self.text = next(((i, x.content) for i, x in special.items() if x.special and not (x.lstrip or x.rstrip)), (None, None))
        space = next((x for x, i in self.t.get_vocab(with_added_tokens=False).items() if self.t.decode([i]) == " "), None)
        self.spaced = np.zeros(self.size, bool)  # the tokens that begin with a space
        if space and not any(x.lstrip or x.rstrip for x in special.values()):
            self.spaced[[i for x, i in self.t.get_vocab(with_added_tokens=False).items() if x.startswith(space)]] = True
        self.batch = getattr(self.t, "encode_batch_fast", self.t.encode_batch)
        self._forget()

    def _forget(self):
        self.clear()
        self.new: list[str] = []
        self.counts = self.starts = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n

    def _learn(self):
        # a piece with the NUL in front came first in a text
        new = [p[1:] if p[:1] == "\0" else " " + p for p in self.new]
        plain = np.fromiter((p[:1] != "\0" and " " not in p and "\u180e" not in p for p in self.new), bool, len(new))
        self.new = []
        counts, flat = np.zeros(len(new), np.int64), [self.flat]
        for which, encoded in ((plain, self._in_a_row), (~plain, self._apart)):
            if which.any():
                at = np.flatnonzero(which)
                n, ids = encoded([new[i] for i in at])
                counts[at] = n
                flat.append(ids)
        # the ids of the plain ones lie before those of the others
        starts, order = np.empty(len(new), np.int64), np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        starts[order] = len(self.flat) + np.cumsum(counts[order]) - counts[order]
        self.counts, self.starts = np.r_[self.counts, counts], np.r_[self.starts, starts]
        self.flat = np.concatenate(flat)

    def _ids(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.array(g.ids, np.int32) for g in self.batch(texts, add_special_tokens=False)])

    def _in_a_row(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = self._ids(["".join(pieces[i:i + _JOINED]) for i in range(0, len(pieces), _JOINED)])
        starts = np.flatnonzero(self.spaced[flat])
        if len(starts) != len(pieces) or starts[0]:  # not a vocabulary of this kind
            return self._apart(pieces)
        return np.diff(np.r_[starts, len(flat)]), flat

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [self.text.join(pieces[i:i + _JOINED]) + self.text for i in range(0, len(pieces), _JOINED)] if self.mark is not None else []
        if self.mark is None or sum(t.count(self.text) for t in joined) != len(pieces):  # no mark, or a piece holds it
            ids = [np.array(g.ids, np.int32) for g in self.batch(pieces, add_special_tokens=False)]
            return np.array([len(x) for x in ids], np.int64), np.concatenate(ids)
        flat = self._ids(joined)
        ends = np.flatnonzero(flat == self.mark)
        return np.diff(np.r_[-1, ends]) - 1, np.delete(flat, ends)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self) > _MOST_PIECES:
            self._forget()
        try:
            return self._encode(texts)
        except BaseException:
            self._forget()  # pieces may have a number, but no ids yet
            raise

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        rows = []
        for t in texts:
            if not t or "\0" in t:  # with a NUL in the text, the mark of a first piece isn't unique
                rows.append(None)
                continue
            # with a space at the end or before white space the plain split would lose a boundary
            parts = _CUT.split(t) if _ODD.search(t) or "\u180e" in t else t.split(" ")
            parts[0] = "\0" + parts[0]
            rows.append(np.fromiter(map(self.__getitem__, parts), np.int64, len(parts)))
        if self.new:
            self._learn()
        out = []
        for k, t in zip(rows, texts):
            if k is None:
                out.append(np.array(self.t.encode(t or "", add_special_tokens=False).ids, np.int32))
                continue
            n = self.counts[k]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.starts[k] - ends + n, n) + np.arange(int(ends[-1]))])
        return out


_KEPT: dict[str, Tokenizer] = {}


def kept(path: str) -> Tokenizer:
    """The tokenizer of this worker, loaded once and with the pieces of the tasks before."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Tokenizer(path)
    return _KEPT[path]


def _groups(column, size: int = 4 << 20):
    part, n = [], 0
    for x in column:
        part.append(x.as_py())
        n += len(part[-1] or "")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def _dtype(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def train_dictionary(docs: DataFrame, path: str, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for serialized id arrays, from at most ``sample`` documents (empty if they are too few to train on)."""
    def run(batches):
        tok = kept(path)
        kind = _dtype(tok.size)
        for batch in batches:
            for part in _groups(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes() for x in tok.encode(part)], pa.binary())], ["ids"])
    few = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample)
    rows = [bytes(r.ids) for r in few.select("text").mapInArrow(run, "ids binary").collect()]
    rows = sorted(r for r in rows if r)
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def _zdict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


_INDEX = np.dtype([("offset", "<i8"), ("length", "<i8"), ("tokens", "<i8")])


def write(docs: DataFrame, tokenizer: str, path: str, *, end: int = END) -> str:
    """Tokenises all of ``docs`` into files below ``path``; returns the path."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer)
    key = zlib.crc32(dictionary)
    spark.createDataFrame([(key, bytearray(dictionary))], "hash bigint, bytes binary").write.parquet(f"{path}/dictionary")
    id_kind = docs.schema["doc_id"].dataType

    def run(batches):
        tok = kept(tokenizer)
        kind = _dtype(tok.size)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(dictionary), write_content_size=True)
        part = TaskContext.get().partitionId()
        block, frames, index, ids_ = 0, [], [], []

        def close():
            nonlocal block, frames, index, ids_
            idx = np.array(index, _INDEX)
            row = pa.RecordBatch.from_arrays([
                pa.array([part]), pa.array([block]), pa.array([len(idx)]), pa.array([int(idx["tokens"].sum())]), pa.array([key]),
                pa.array([kind.str]), pa.array([ids_], pa.list_(docs_type)), pa.array([idx.tobytes()], pa.binary()),
                pa.array([b"".join(frames)], pa.binary())], ["part", "block", "docs", "tokens", "hash", "kind", "doc_ids", "index", "data"])
            block, frames, index, ids_ = block + 1, [], [], []
            return row
        docs_type, size = None, 0
        for batch in batches:
            docs_type = batch.schema.field(0).type
            done = 0
            for texts in _groups(batch.column(1)):
                for doc, ids in zip(batch.column(0).slice(done, len(texts)).to_pylist(), tok.encode(texts)):
                    frame = pack.compress(np.append(ids, end).astype(kind).tobytes())
                    index.append((sum(map(len, frames)) if not index else index[-1][0] + index[-1][1], len(frame), len(ids) + 1))
                    frames.append(frame)
                    ids_.append(doc)
                    size += len(frame)
                    if len(frames) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                        size = 0
                        yield close()
                done += len(texts)
        if frames:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = (f"part int, block bigint, docs bigint, tokens bigint, hash bigint, kind string, "
              f"doc_ids array<{id_kind.simpleString()}>, index binary, data binary")
    blocks = ordered.mapInArrow(_narrow(run), schema)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def _narrow(run):
    """Casts the part number to the schema's 32 bits."""
    def cast(batches):
        for b in run(batches):
            yield b.set_column(0, "part", b.column(0).cast(pa.int32()))
    return cast


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """The blocks with ``first``, the ids before each block, and the dictionary (its size is bounded)."""
    d = spark.read.parquet(f"{path}/dictionary").first()
    b = spark.read.parquet(f"{path}/blocks")
    # totals per part, prefix-summed over the parts; then over the blocks inside each part
    parts = b.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("p_"), before.alias("base"))
    small = b.select(F.col("part").alias("q_"), F.col("block").alias("b_"), F.coalesce(F.sum("tokens").over(
        W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    first = small.join(parts, small.q_ == parts.p_).select("q_", "b_", (F.col("base") + F.col("inside")).alias("first"))
    b = b.join(first, (b.part == first.q_) & (b.block == first.b_)).drop("q_", "b_")
    return b, bytes(d.bytes)


def _unpack(dictionary: bytes, want: int):
    if zlib.crc32(dictionary) != want:
        raise ValueError("the block was written with another dictionary")
    return zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))


def read(spark: SparkSession, path: str, *, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids per document (``digest``: ids_crc32 in place of ids), read from the files."""
    blocks, dictionary = _blocks(spark, path)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                first, key, kind, data = (batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("first", "hash", "kind", "data"))
                idx = np.frombuffer(batch.column(batch.schema.get_field_index("index"))[k].as_py(), _INDEX)
                unpack = _unpack(dictionary, key)
                start = first + np.cumsum(idx["tokens"]) - idx["tokens"]
                out = [np.frombuffer(unpack.decompress(data[o:o + n]), kind).astype("<u4") for o, n, _ in idx.tolist()]
                names = batch.column(batch.schema.get_field_index("doc_ids"))[k].values
                last = (pa.array([zlib.crc32(x.tobytes()) for x in out], pa.int64()) if digest
                        else pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([names, pa.array(start, pa.int64()), pa.array([len(x) for x in out], pa.int64()), last],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.select("first", "hash", "kind", "doc_ids", "index", "data").mapInArrow(
        run, f"doc_id {kind}, start bigint, n_tokens bigint, {'ids_crc32 bigint' if digest else 'ids array<int>'}")


def read_some(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """doc_id, ids of a few documents: only blocks that name one of them are opened, only its frame is unpacked."""
    blocks, dictionary = _blocks(spark, path)
    wanted = set(doc_ids)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                names, index, key, kind, data = (batch.column(c)[k].as_py() for c in range(5))
                hits = [i for i, x in enumerate(names) if x in wanted]
                unpack, idx = _unpack(dictionary, key), np.frombuffer(index, _INDEX)
                ids = [np.frombuffer(unpack.decompress(data[idx[i]["offset"]:idx[i]["offset"] + idx[i]["length"]]), kind).astype(np.int32) for i in hits]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in hits], batch.schema.field(0).type.value_type),
                                                  pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    hit = F.arrays_overlap("doc_ids", F.array(*[F.lit(i) for i in doc_ids]).cast(blocks.schema["doc_ids"].dataType))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.where(hit).select("doc_ids", "index", "hash", "kind", "data").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
