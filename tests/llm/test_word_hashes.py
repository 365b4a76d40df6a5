"""Words are hashed many at a time, with the library's hash; sets and orders are what they were."""

import numpy as np
import pyarrow as pa
import xxhash

from featlens.llm import common, jaccard
from featlens.llm.common import WordHashes, shingles


def texts():
    rng = np.random.default_rng(5)
    signs = [bytes([c]) for c in range(1, 128)] + ["é".encode(), "ß".encode(), "漢".encode(), b" ", b"  ", b"\t\r\n", b"\x0b", b"\x0c", b"\0"]
    made = [b"".join(signs[i] for i in rng.integers(0, len(signs), n)) for n in (1, 5, 300, 3000)]
    words = [bytes(rng.integers(33, 127, n, dtype=np.uint8)) for n in [*range(1, 70), 1000]]
    return [None, b"", b" ", b" \n ", b"a", b" a", b"a ", b" ".join(words), b"  ".join(words[::-1]) + b" ", *made]


def one_by_one(text):
    return np.array([xxhash.xxh3_64_intdigest(w) for w in (text or b"").lower().split()], np.uint64)


def test_hashes_are_the_librarys(monkeypatch):
    for together, size in ((200_000, 1 << 20), (60, 1 << 20), (1, 7)):
        monkeypatch.setattr(common, "TOGETHER_BYTES", together)
        monkeypatch.setattr(common.pieces, "__defaults__", (size,))
        hashes = WordHashes()
        for t in texts():
            np.testing.assert_array_equal(hashes.of(t), one_by_one(t))
        for n in (1, 4, 5):
            got = list(hashes.shingles(iter(texts()), n))
            assert len(got) == len(texts())
            for t, s in zip(texts(), got):
                np.testing.assert_array_equal(s, shingles(one_by_one(t), n))


def test_short_words_are_not_hashed_one_at_a_time(monkeypatch):
    long = []

    class Counted:
        xxh3_128_digest = xxhash.xxh3_128_digest

        @staticmethod
        def xxh3_64_intdigest(w):
            long.append(w)
            return xxhash.xxh3_64_intdigest(w)
    monkeypatch.setattr(common, "xxhash", Counted)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some short words and " + "x" * 17, "the sixteen bytes" + " y" * 500])], ["doc_id", "text"])
    out = [b for b in jaccard._describe(4)([batch])]
    assert out[0].column(1).to_pylist() == [2, 4]
    assert long == [b"x" * 17]


def test_prefixes_are_the_rarest_grams():
    counts = np.zeros(jaccard.BUCKETS, np.uint32)
    hashes = WordHashes()
    rows = ["the one and only text of so many words that its prefix has a few", "b a", "", None]
    sets = [jaccard._sets(hashes, t and t.encode(), 2) for t in rows]
    counts[(sets[0] >> np.uint64(44)).astype(np.int64)] = np.arange(len(sets[0]))[::-1] % 3 + (1 << 31)

    class Order:
        value = counts
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(rows, pa.string())], ["doc_id", "text"])
    got = [tuple(r.values()) for b in jaccard._prefixes(2, 50, Order)([batch]) for r in b.to_pylist()]
    want = []
    for i, s in enumerate(sets):
        order = sorted(s.tolist(), key=lambda g: (int(counts[g >> 44]), g))[:len(s) - -(-len(s) // 2) + 1] if len(s) else []
        want += [(g - (1 << 64) if g >> 63 else g, i, p, len(s)) for p, g in enumerate(order)]
    assert got == want


def test_overlaps_counts_common_grams():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64) * np.uint64(0x0600000000000001)) for _ in range(2))
        both = len(set(x.tolist()) & set(y.tolist()))
        assert jaccard.overlaps(x, y, 60) == (100 * both >= 60 * (len(x) + len(y) - both))
