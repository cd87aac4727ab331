"""Every query with an oracle gives the oracle's rows, whichever way the tables are dealt."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("PLUMBLINE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
LIBRARY = sorted(n for n in entry.queries() if n != "pipeline" and not n.startswith("op"))


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", LIBRARY)
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert rows
        return
    found = sql.sql(oracle)
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in places) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
