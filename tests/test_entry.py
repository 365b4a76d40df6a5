import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) > 0 and {"rank", "feature1", "feature2", "score"} <= set(rows[0].asDict())


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["corr_pearson", "suggest_pairs", "describe", "impute_median", "bin_quantile",
                                  "rate_stats", "split_exact", "cv_folds", "roc_auc", "reintroduce"])
def test_oracle_agrees_at_sf0001(spark, name):
    df = E.queries()[name](spark, SF001)
    s_rows = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    d_rows = sorted(tuple(r[k] for k in order) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert s_rows == d_rows
