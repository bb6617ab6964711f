import math

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
LONG = "x" * 300


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Files that are there twice, or under one id with other paths or contents, of which the ends alone may differ."""
    d = str(tmp_path_factory.mktemp("hits"))
    nodes = [(i, f"i{i % 17}" if i % 13 else None, [math.sin((i if i % 7 else 7) * j + 1) for j in range(1, 65)], [[1]], 0) for i in range(1, 141)]
    files = [(i, "i", f"p{i}", f"{i} {LONG}") for i in range(1, 131)] * 2 + [(50, "i", "p50", f"50 {LONG}y"), (100, "i", "p100", None), (100, "i", None, "é" * 201), (7, "i", "other", f"7 {LONG}")]
    spark.createDataFrame(nodes, "node_id long, index_name string, vector array<float>, connections array<array<long>>, level int").write.parquet(f"{d}/hnsw_nodes.parquet")
    spark.createDataFrame(files, "file_id long, index_name string, path string, content string").write.parquet(f"{d}/stored_files.parquet")
    return d


def test_hits_are_their_sql(spark, folder):
    con = duckdb.connect()
    for t in ("hnsw_nodes", "stored_files"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    key = lambda r: (r[0], -r[1], *map(repr, r[2:]))
    want = sorted(con.execute(entry.oracle_sql()["service_search_hits"]).fetchall(), key=key)
    got = sorted(map(tuple, entry.queries()["service_search_hits"](spark, folder).collect()), key=key)
    assert got == want and len(want) > 20
