"""The pipeline's Python functions hold little: a bounded memory of words, and each text once."""

import pyarrow as pa
from pyspark.sql import functions as F

from featlens.llm import passages, piecewise, toxicity
from featlens.session import owned_tables
from tests.llm.test_tables_and_exchanges import tables


def test_encoder_forgets_words():
    model = piecewise.Vocabulary(["a", "b", "▁", *[f"<0x{i:02X}>" for i in range(256)]], [piecewise.NORMAL] * 3 + [piecewise.BYTE] * 256,
                                 [-1.0, -2.0, -3.0] + [0.0] * 256, True)._derive()
    enc, most = piecewise.Encoder(model), 0
    for k in range(8):
        text = " ".join(format(i, "b").translate({48: "a", 49: "b"}) for i in range(k * 60_000, (k + 1) * 60_000))
        assert sum(map(len, enc.encode([text]))) == len(text) + 1
        most = max(most, len(enc))
    assert most < 400_000
    assert len(list(piecewise.chunks(pa.array(["x" * 1000] * 4000)))) >= 7


def test_toxicity_takes_a_text_once(spark):
    docs = spark.createDataFrame([(1, "bad word", "en"), (2, None, "de"), (None, "good", None)], "doc_id long, Text string, lang string")
    keys = [k for w in toxicity.vocabulary(b"bad") for k in toxicity.keys(w)]
    model = toxicity.ToxicityModel({k: 50.0 for k in keys}, -10.0)
    kept = toxicity.clean(docs, model)
    plan = kept._jdf.queryExecution().analyzed()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().apply(0)
    assert [c.name() for c in (plan.children().apply(0).output().apply(i) for i in range(plan.children().apply(0).output().size()))] == ["doc_id", "held_out", "row"]
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted(docs.where(F.coalesce("doc_id", F.lit(0)) != 1).collect(), key=str)


def test_passages_leave_the_pairs_alone(spark):
    body = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, body), (2, "x y " + body), (3, None), (4, "short")], "doc_id long, text string")
    before = tables(spark)
    with owned_tables(spark):
        found = passages.find(docs)
        assert len(tables(spark) - before) == 1  # no windows, no bit table
        assert [(r.doc_id, r.partner_id, r.start, r.end) for r in found.collect()] == [(2, 1, 2, 82)]
    assert tables(spark) == before
