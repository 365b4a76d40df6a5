"""Windows of frequent hashes meet by their kinds; a batch's windows are unfolded together."""

from collections import Counter

import pyarrow as pa

from featlens.llm import passages

WINDOW = "key bigint, doc_id bigint, k int, l int, c int, r int, near bigint, far bigint"


def _joined(df):
    """The most rows that a join of the plan made, once it has run."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if "Join" in name:
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_windows_of_one_kind_are_joined_together(spark):
    near, far = 1 | 2 << 16 | 3 << 32 | 4 << 48, 1 | 5 << 21 | 6 << 42
    rows = [(9, i, 0, 1, 3, 60, near, far) for i in range(2000)] + [(9, 2000, 0, 0, 4, 70, 1, 0), (9, 2001, 0, 0, 4, 70, 7, 0), (8, 1, 0, 0, 4, 70, near, far)]
    df = passages._stars_of_hot(spark.createDataFrame(rows, WINDOW))
    got = Counter(tuple(r) for r in df.collect())
    assert got == Counter([(0, i, 0, 0, 1, 60, 1, 60, 3) for i in range(1, 2000)] + [(0, 2000, 0, 1, 0, 70, 1, 60, 4)])
    assert 0 < _joined(df) < 1000  # 14,000 when every window met its seven groups


def test_pairs_unfold_to_their_windows():
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("k", "l", "r", "rl", "rr", "shift")] + [("cs", pa.list_(pa.int32()))]))
    one = [{"k": 1, "l": 2, "r": 60, "rl": 12, "rr": 70, "shift": -10, "cs": [5, 9]}, {"k": 0, "l": 3, "r": 61, "rl": 0, "rr": 58, "shift": 3, "cs": [7]}]
    w = pa.array([one[:1], one, one[1:], [], one], kind).slice(1)
    t, ends = passages._unfolded(w)
    for i, x in enumerate(w.to_pylist()):
        assert t[ends[i]:ends[i + 1]].tolist() == [[d["k"], d["l"], d["r"], d["rl"], d["rr"], c, d["shift"]] for d in x for c in d["cs"]]
    assert [len(x) for x in passages._unfolded(pa.array([], kind))] == [0, 1]


def test_hashes_of_many_windows(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text if i % 2 else f"{text} x{i} " * 2) for i in range(40)], "doc_id long, text string")
    keys = passages._windows(passages.LEAST, 1)
    assert len(passages._hot(docs, keys)) == 0
    monkeypatch.setattr(passages, "HOT", 30)
    hot = passages._hot(docs, keys)
    counts = Counter(r.key for r in docs.mapInArrow(keys, "key bigint").collect())
    assert sorted(hot.tolist()) == sorted(k % 2**64 for k, n in counts.items() if n > 30) and len(hot)
    assert passages._is_in(hot, hot).all() and not passages._is_in(hot, hot + hot.dtype.type(1)).any()
