"""corr_spearman, corr_spearman_all: ranks of columns with few values come by broadcast, with the results of the shuffled ones."""

import random

import pandas as pd
import pytest

from featlens.operators import assoc


@pytest.mark.parametrize("few", [-1, 12, 10_000])
def test_spearman_equals_pandas(spark, monkeypatch, few):
    monkeypatch.setattr(assoc, "FEW_VALUES", few)
    rng = random.Random(4)
    rows = [(float(rng.randint(0, 3)) if i % 5 else None, rng.random(), -0.0 if i % 3 else 0.0, rng.random() + i / 100 if i % 7 else None, float(i % 4))
            for i in range(300)] + [(None, None, None, None, None)] * 2
    cols = ["a", "b", "c", "d", "e"]
    m = assoc.spearman_matrix(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), cols)
    got = {(r.f1, r.f2): (r.r, r.n) for r in m.collect()}
    frame = pd.DataFrame(rows, columns=cols)
    assert len(got) == 25
    for x in cols:
        for y in cols:
            both = frame[[x, y]].dropna() if x != y else frame[[x]].dropna()
            r = None if both.nunique().min() < 2 else 1.0 if x == y else both.rank().corr().iloc[0, 1]
            assert got[x, y] == (None if r is None else pytest.approx(r), len(both))
