"""Every query against its SQL, on the smallest data, where that is there."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
duckdb = pytest.importorskip("duckdb")
SQL = {k: v for k, v in entry.oracle_sql().items() if not (k[0] == "p" and k[1].isdigit())}


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, views, name):
    got = entry.queries()[name](spark, DATA)
    cursor = views.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted((tuple(plain(x) for x in r) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in SQL and not (k[0] == "p" and k[1].isdigit())))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
