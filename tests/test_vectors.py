import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvex import config, errors
from corvex.functions import vectors as V
from corvex.plans import knn

CASES = [
    ("cosine", [1, 2, 3], [1, 2, 3], 0.0),
    ("cosine", [1, 0], [0, 1], 1.0),
    ("cosine", [1, 0], [-1, 0], 2.0),
    ("cosine", [0, 0], [1, 2], 1.0),
    ("euclidean", [0, 0], [3, 4], 5.0),
    ("manhattan", [0, 0], [3, 4], 7.0),
    ("dot", [1, 2, 3], [4, 5, 6], -32.0),
]


def test_distances(spark):
    for metric, a, b, want in CASES:
        df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
        assert df.select(V.distance(metric, F.col("a"), F.col("b"))).first()[0] == pytest.approx(want, abs=1e-12)
        assert df.select(V.squared_distance(metric, F.col("a"), F.col("b"))).first()[0] == pytest.approx(want**2, abs=1e-12)


def test_lengths_must_match(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="expected dimension 1, got 2"):
        df.select(V.distance("cosine", F.col("a"), F.col("b"))).collect()
    with pytest.raises(errors.InvalidConfig):
        V.distance("hamming", F.col("a"), F.col("b"))


def test_scalar_functions(spark):
    one = spark.range(1)
    assert one.select(V.normalized(V.literal([3, 4]))).first()[0] == pytest.approx([0.6, 0.8])
    assert one.select(V.normalized(V.literal([0, 0]))).first()[0] == [0, 0]
    assert one.select(V.cosine_similarity(V.literal([0, 0]), V.literal([1, 0]))).first()[0] == 0
    assert one.select(V.zeros(3)).first()[0] == [0, 0, 0]
    assert [one.select(V.similarity(F.lit(float(x)))).first()[0] for x in (0, 1, 9)] == [1.0, 0.5, 0.1]
    assert one.select(V.service_score(F.lit(0.25))).first()[0] == 0.75


vectors = st.lists(st.floats(-10, 10, width=32), min_size=3, max_size=3)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(vectors, vectors, vectors), min_size=1, max_size=20))
def test_metric_laws(spark, rows):
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, c array<double>")
    d = lambda m, x, y: V.distance(m, F.col(x), F.col(y))
    for m in ("euclidean", "manhattan"):
        for ab, ba, ac, cb, aa in df.select(d(m, "a", "b"), d(m, "b", "a"), d(m, "a", "c"), d(m, "c", "b"), d(m, "a", "a")).collect():
            assert ab >= 0 and aa == 0 and ab == pytest.approx(ba) and ab <= ac + cb + 1e-6
    assert all(-1e-9 <= r[0] <= 2 + 1e-9 for r in df.select(d("cosine", "a", "b")).collect())
    for (n,) in df.select(V.norm(V.normalized(F.col("a")))).collect():
        assert n == 0 or n == pytest.approx(1)


def test_search(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y"), (3, [1.0, 0.0], "z"), (4, None, "x"), (5, [0.9, 0.1], "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, _v string")
    assert [r[0] for r in knn.search(df, [1, 0], 3).collect()] == [1, 3, 5]
    assert knn.search(df, [1, 0], 0).count() == 0
    assert knn.search(df.limit(0), [1, 0], 3).count() == 0
    assert [r[0] for r in knn.search(df, [1, 0], 3, min_similarity=0.9999).collect()] == [1, 3]
    with pytest.raises(Exception, match="expected dimension"):
        knn.search(df, [1, 0, 0], 3).collect()


@pytest.mark.parametrize("metric", config.METRICS)
@pytest.mark.parametrize("block", [4096, 3])
def test_batch_is_search(spark, metric, block, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", block)
    rows = [(i, [math.sin(i * j + 1) for j in range(1, 9)], f"i{i % 3}") for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, index_name string")
    got = {(r.q_id, r["rank"]): (r.vec_id, r.distance) for r in knn.search_batch(df, knn.query_set(df, 5), 4, metric).collect()}
    for q in range(0, 40, 5):
        want = knn.search(df, knn.vector_of(df, q), 4, metric).collect()
        assert [got[q, i + 1][0] for i in range(4)] == [r.vec_id for r in want]
        assert [got[q, i + 1][1] for i in range(4)] == pytest.approx([r.distance for r in want], abs=1e-7)
    merged = knn.multi_index(df, knn.query_set(df, 5), 4, metric)
    assert {(r.q_id, r["rank"]): r.vec_id for r in merged.collect()} == {k: v[0] for k, v in got.items()}
    assert knn.recall(merged, knn.search_batch(df, knn.query_set(df, 5), 4, metric)).first()[0] == 1.0
    assert knn.search_batch(df.limit(0), knn.query_set(df, 5), 4, metric).count() == 0


def test_settings():
    assert config.GraphConfig().m0 == 60 and config.GraphConfig.fast().prune_ratio == 0.3 and config.HnswConfig.accurate().m == 32
    for bad in (dict(m=0), dict(m0=1), dict(ef_construction=1), dict(prune_ratio=2), dict(beam_width=0), dict(hub_percentile=-1), dict(metric="x")):
        with pytest.raises(errors.InvalidConfig):
            config.GraphConfig(**bad)
    with pytest.raises(errors.InvalidConfig):
        config.QuantizerConfig(subquantizers=7).width(64)
    assert config.QuantizerConfig().compression(128) == 64
    assert config.SearchConfig.fast(7).ef == 14 and config.SearchConfig.accurate(7).ef == 70
