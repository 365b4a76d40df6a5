"""Blocks of queries meet blocks of candidates without a broadcast: the copies for the groups never pass the driver."""

from pyspark.sql import functions as F

from featlens.llm import neighbours, topk, vectors as V


def rows(spark, n, dim=3):
    v = F.array(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 500 - 1).cast("float") for k in range(dim)])
    return spark.range(n).select(F.col("id").alias("vec_id"), v.alias("embedding"))


def test_every_pair_of_blocks_once_and_no_broadcast(spark):
    d = V.usable(rows(spark, 500)).repartition(3)
    c = V.blocks(d, 40).localCheckpoint()
    q = V.blocks(d.where("vec_id % 50 = 0"), 4).localCheckpoint()
    pairs = V.against(q, c, groups=7)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = sorted((bytes(r.ids), bytes(r.q_ids)) for r in pairs.collect())
    want = sorted((bytes(a.ids), bytes(b.ids)) for a in c.collect() for b in q.collect())
    assert got == want and len(want) > 30


def test_searches_have_no_broadcast_of_queries(spark):
    for search in (neighbours.search, topk.search):
        found = search(rows(spark, 300))
        assert "BroadcastNestedLoopJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString())
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert found.groupBy("query_id").count().where("count = 5").count() == 6
