import math

import pytest
from pyspark.sql import functions as F

from corvex.plans import knn


def sent(df, *names):
    """Rows that the Python nodes of an executed plan gave."""

    def walk(node):
        kind, inner = node.getClass().getSimpleName(), []
        if kind == "AdaptiveSparkPlanExec":
            inner = [node.executedPlan()]
        elif kind.endswith("QueryStageExec"):
            inner = [node.plan()]
        else:
            inner = [node.children().apply(i) for i in range(node.children().length())]
        return (node.metrics().apply("pythonNumRowsReceived").value() if kind in names else 0) + sum(map(walk, inner))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("block", [4096, 3])
def test_rows_do_not_grow_with_the_indexes(spark, block, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", block)
    rows = [(i, [math.sin(i * j + 1) for j in range(1, 9)], f"i{i}") for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, index_name string").repartition(4)
    found = knn.multi_index(df, knn.query_set(df, 40), 2)
    got = {(r.q_id, r["rank"]): (r.vec_id, r.index_name) for r in found.collect()}
    near = {(r.q_id, r["rank"]): (r.vec_id, f"i{r.vec_id}") for r in knn.search_batch(df, knn.query_set(df, 40), 2).collect()}
    assert got == near and len(got) == 12
    assert 12 <= sent(found, "MapInArrowExec", "FlatMapCoGroupsInArrowExec") <= 6 * 2 * (4 if block > 3 else math.ceil(240 / 12))


@pytest.mark.parametrize("block", [4096, 1])
def test_ties_and_null_indexes(spark, block, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", block)
    rows = [(0, [1.0, 0.0], "q"), (50, [0.0, 1.0], "q"), (9, [0.5, 1e-6], None), (7, [2.0, 2e-6], "b"), (8, [1.0, 0.0], ""), (8, [1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, index_name string")
    got = knn.multi_index(df, knn.query_set(df).where("q_id = 0 or q_id = 50"), 5, ties=9).where("q_id = 0").orderBy("rank").collect()
    assert [(r.vec_id, r.index_name) for r in got] == [(0, "q"), (7, "b"), (8, ""), (8, "a"), (9, None)]
    assert got[1].distance == pytest.approx(5e-13, rel=0.01)  # ties by rounding, given unrounded


def test_context_puts_hits_without_an_index_last(spark):
    rows = [(0, 0.5, None, "p", "none"), (0, 0.5, "i", None, "lost"), (0, 0.5, "i", "p", "z"), (0, 0.5, "i", "p", "a")]
    got = knn.context(spark.createDataFrame(rows, "q_id long, score double, index string, path string, snippet string"), 3).select(F.split("context", "\n\n")).first()[0]
    assert got == ["[i] p\na", "[i] p\nz", "[i] \nlost"]
