import os

import duckdb
import pytest

from bytelake.plans.shapes import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.execute(ORACLE[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == cols
    theirs = sorted((tuple(plain(r[order.index(c)]) for c in cols) for r in want.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str) == theirs
