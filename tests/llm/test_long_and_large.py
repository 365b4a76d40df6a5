"""Long words, large vectors, the sample's sparse rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlens.llm import piecewise, topk, toxicity
from featlens.llm.queries import PIECES, vocabulary


@pytest.fixture(scope="module")
def pieces():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = vocabulary(PIECES)
    return sentencepiece.SentencePieceProcessor(model_file=path), piecewise.load(path)


def test_long_words_equal_the_library(pieces):
    lib, v = pieces
    rnd = random.Random(3)
    letters = ["abcdefghijklmnopqrstuvwxyz", "ab", "eaoth", "-=_.*#/\\0123456789", "aé漢ßx"]
    words = ["".join(rnd.choices(s, k=rnd.randint(1, 700))) for s in letters for _ in range(40)]
    words += [("".join(rnd.choices("abcdehstin", k=rnd.randint(1, 6)))) * 90 for _ in range(60)]
    words += ["".join(rnd.choices(letters[0], k=300_000)), "ha" * 20_000]
    for w, got in zip(words, piecewise.Encoder(v).encode(words)):
        assert got.tolist() == lib.encode(w), w[:60]


def test_vectors_beyond_64_bits_take_no_part(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(size=4)]) for i in range(120)]
    rows[7] = (7, [3e6, -2e6, 1.0, 0.0])  # its square, some 8.5e17, fits a long
    small = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    large = spark.createDataFrame([(150, [1e30, 0.0, 0.0, 1.0]), (151, [-1e8, 1e8, 0.0, 0.0]), (200, [1e308] * 4)], small.schema)
    got = {tuple(r) for r in topk.search(small.union(large)).collect()}
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
    want = set()
    for q in (0, 50, 100):
        best = sorted(((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q))[:5]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    assert got == want


def test_sparse_rows_hold_the_keys_of_three_texts(spark):
    said = ["vile words here", "Vile, words there", "(vile) nothing", None, "", "words alone"]
    rows = [(i, t, int(i < 3)) for i, t in enumerate(said)]
    s = toxicity.gather(spark.createDataFrame(rows, "doc_id long, text string, y int"), least=3)
    sets = [{k for w in toxicity.vocabulary((t or "").encode()) for k in toxicity.keys(w)} for t in said]
    kept = {k for k in set().union(*sets) if sum(k in x for x in sets) >= 3}
    assert kept and s.y.tolist() == [1, 1, 1, 0, 0, 0]
    for i, x in enumerate(sets):
        assert set(s.names[s.col[s.row == i]].tolist()) == x & kept
    none = toxicity.gather(spark.createDataFrame([], "doc_id long, text string, y int"))
    assert len(none.y) == 0 and len(none.names) == 0


def test_pattern_votes():
    assert [toxicity.patterns(t) for t in (b"soooo", b"an id1ot", b"i.d.i.o.t", b"plain words", None)] == [1, 2, 4, 0, 0]


def test_fit_without_toxic_rows_scores_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert toxicity.score(docs, model).where("predicted = 1").count() == 0
