"""op5 and the pipeline: what a stage wrote on its way goes; the rows of a mix are dealt out twice, not three times."""

import os

from pyspark.sql import functions as F

from featlens.llm import jaccard, mix
from featlens.llm.common import WordHashes
from featlens.session import ARROW_ROWS, SHUFFLES_GO, ensure_checkpoint_dir, materialize


def tables(spark):
    return {x for x in os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")) if x.startswith("featlens-")}


def some(spark):
    near = [(i, " ".join(["x"] * (i % 2) + [f"w{j}" for j in range(60)])) for i in range(6)]
    return spark.createDataFrame(near + [(9, None), (10, "alone here")], "doc_id long, text string")


def test_jaccard_leaves_one_table(spark):
    before, docs = tables(spark), some(spark)
    groups = jaccard.groups(docs)
    assert len(tables(spark) - before) == 1
    kept = jaccard.one_of_each(docs)
    assert len(tables(spark) - before) == 2  # the doc_ids that go
    assert {r.doc_id: r.component_id for r in groups.collect()} == {i: 0 for i in range(6)} | {9: 9, 10: 10}
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9, 10]


def test_sets_come_in_small_batches(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(jaccard, "_SET_BYTES", 1000)
    texts = ["", None, *[" ".join(f"{i}-{j}" for j in range(50)) for i in range(20)], "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    out = list(jaccard._whole(4)([batch, batch.slice(0, 0)]))
    assert len(out) > 5 and max(b.num_rows for b in out) <= 6
    rows = [r for b in out for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert [i for i, _ in rows] == list(range(len(texts)))
    assert [g for _, g in rows] == [jaccard._sets(WordHashes(), t and t.encode(), 4).tobytes() for t in texts]


def test_shuffle_files_go_with_the_write_and_settings_come_back(spark):
    seen = []
    rows = spark.conf.get(ARROW_ROWS)

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], ["n"])
    t = materialize(spark.range(50).repartition(1).mapInArrow(sizes, "n int"), 7)
    seen = [r.n for r in t.collect()]
    assert max(seen) == 7 and sum(seen) == 50
    assert spark.conf.get(ARROW_ROWS) == rows and spark.conf.get(SHUFFLES_GO, None) in (None, "false")


def exchanges(plan, column):
    """Exchanges below ``plan`` whose rows have ``column``."""
    n = plan.nodeName() == "Exchange" and f"{column}#" in plan.output().mkString(",")
    return n + sum(exchanges(plan.children().apply(i), column) for i in range(plan.children().size()))


def test_rows_of_a_mix_are_dealt_out_twice(spark):
    rows = [(i, f"{'w ' * (i % 7)}", [None, "a", "b", ""][i % 4]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mix.mixture(docs)._jdf.queryExecution().executedPlan()
        assert exchanges(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan, "row") == 2
        got = mix.plan(docs).groupBy("source").agg(F.sum("size").alias("n"), F.max("source_size").alias("s"), F.count("*").alias("rows")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 4 and all(r.n == r.s and r.rows == 50 for r in got)
