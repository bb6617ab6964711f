import numpy as np
import pytest
from pyspark.sql import functions as F

from corvex import errors
from corvex.config import GraphConfig, HnswConfig, QuantizerConfig
from corvex.operators import graphs, hnsw, quantizer
from corvex.plans import knn
from corvex.sources import store


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(32)], f"i{i % 2}") for i in range(200)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, index_name string").cache()


def test_layered_recall(spark, data, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 60)
    graph = hnsw.build_layered(data, HnswConfig.accurate(), index="index_name").cache()
    assert graph.count() == 200 and graph.where("is_entry").count() == graph.select("shard").distinct().count() >= 4
    assert graph.select(F.max(F.size(F.get("connections", F.lit(0))))).first()[0] <= 64
    found = hnsw.search_layered(graph, knn.query_set(data, 10), 10, 100).withColumnRenamed("id", "vec_id")
    assert knn.recall(found, knn.search_batch(data, knn.query_set(data, 10))).first()[0] >= 0.95
    assert hnsw.search_layered(graph.limit(0), knn.query_set(data, 10), 10).count() == 0
    with pytest.raises(Exception, match="expected dimension"):
        hnsw.search_layered(graph, spark.createDataFrame([(1, [1.0])], "q_id long, q_vec array<float>"), 3).collect()


def test_beam_search(spark, data):
    exact = knn.search_batch(data, data.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec")), 13)
    edges = graphs.symmetric(exact.where("q_id <> vec_id").select(F.col("q_id").alias("src"), F.col("vec_id").alias("dst")))
    links = graphs.adjacency(edges).cache()
    queries = knn.query_set(data, 40)
    for config in (GraphConfig(ef_search=64, beam_width=8), GraphConfig(ef_search=64, beam_width=8, prune_ratio=0.3)):
        found, fetched = hnsw.beam_search(links, data, queries, 0, 10, config, id="vec_id", vector="embedding")
        assert knn.recall(found, exact.where("rank <= 10").join(queries, "q_id", "left_semi")).first()[0] >= 0.9
        assert 0 < hnsw.recompute_share(fetched, queries.count(), 200) <= 1
    with pytest.raises(errors.IndexNotBuilt):
        hnsw.beam_search(links, data, queries, 999, id="vec_id", vector="embedding")


def test_graph_tables(spark):
    nodes = spark.createDataFrame([(0, [[]], 0), (1, [[0, 0, 1, None, 9]], 0), (2, [[0, 1], [1]], 1), (3, None, None)], "node_id long, connections array<array<long>>, level int")
    edges = graphs.edges_of(nodes)
    assert {tuple(r) for r in edges.collect()} == {(0, 1, 0), (0, 1, 9), (0, 2, 0), (0, 2, 1), (1, 2, 1)}
    flat = graphs.existing(edges, nodes).select("src", "dst").distinct()
    assert {r.node_id: r.neighbors for r in graphs.adjacency(flat).collect()} == {1: [0], 2: [0, 1]}
    assert graphs.symmetric(flat).count() == 6
    assert tuple(graphs.entry_point(nodes).first()) == (2, 1)
    assert graphs.entry_point(nodes.limit(0)).count() == 0
    assert {r.node_id: r.hop for r in graphs.reachable(flat, nodes.where("node_id = 2"), 3).collect()} == {2: 0, 0: 1, 1: 1}
    rows = graphs.adjacency(flat)
    assert graphs.neighbors_of(rows, 2) == [0, 1] and graphs.neighbors_of(rows, 999) is None
    assert graphs.neighbors_of(graphs.with_neighbors(rows, 2, [5]), 2) == [5]
    assert graphs.with_neighbors(rows, 999, [5]).exceptAll(rows).count() == 0
    more = graphs.with_node(rows, 7, [1, 2])
    assert {r.node_id: r.offset for r in graphs.offsets(more, block=2).collect()} == {1: 0, 2: 1, 7: 3}
    n = F.array(*(F.lit(i) for i in range(10)))
    one = spark.range(1)
    size = lambda c, filled=0: one.select(F.size(graphs.prune(n, c, filled))).first()[0]
    assert [size(GraphConfig(prune_ratio=r, pruning="local")) for r in (0, 0.3, 0.5, 1.0)] == [10, 7, 5, 1]
    assert size(GraphConfig(prune_ratio=0.5, ef_search=64), 32) == 8


def test_quantizer(spark, data):
    config = QuantizerConfig(subquantizers=4, centroids=16, iterations=8, seed=5)
    book = quantizer.train(data, config, 32).cache()
    assert book.count() == 64
    codes = quantizer.encode(data, book, config).cache()
    joined = quantizer.assign(quantizer.subvectors(data, config, 32), book).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sq", "code"))), lambda s: s["code"]).alias("codes"))
    assert codes.exceptAll(joined).count() == 0
    decoded = quantizer.decode(codes, book)
    coarse = quantizer.decode(quantizer.encode(data, quantizer.first_codebook(data, config, 32), config), quantizer.first_codebook(data, config, 32))
    error = lambda d: quantizer.reconstruction_error(data, d).agg(F.avg("error")).first()[0]
    assert error(decoded) < error(coarse)
    q = knn.vector_of(data, 0)
    exact = {r.vec_id: np.linalg.norm(np.array(q) - np.array(r.decoded)) for r in decoded.collect()}
    assert all(r.distance == pytest.approx(exact[r.vec_id], abs=1e-6) for r in quantizer.asymmetric(codes, book, q, config).collect())
    best = {r.vec_id for r in quantizer.two_level(data, codes, book, q, config, 10, 100).collect()}
    assert len(best & {r.vec_id for r in knn.search(data, q, 10).collect()}) >= 8
    with pytest.raises(errors.EmptyCollection):
        quantizer.train(data.limit(0), config, 32)
    with pytest.raises(errors.IndexNotBuilt):
        quantizer.encode(data, book.limit(0), config)


def test_two_clusters(spark):
    rows = [(i, [1.0 + i / 100, 0.0]) for i in range(3)] + [(i, [-1.0 - i / 100, 0.0]) for i in range(3, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    config = QuantizerConfig(subquantizers=1, centroids=2, iterations=10, seed=1)
    codes = {r.vec_id: r.codes[0] for r in quantizer.encode(df, quantizer.train(df, config, 2), config).collect()}
    assert len({codes[i] for i in range(3)}) == len({codes[i] for i in range(3, 6)}) == 1 and codes[0] != codes[5]


def test_store(spark, data, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(errors.StorageError):
        store.load(spark, path)
    assert not store.delete(spark, path)
    store.save(data, path, by="index_name")
    store.save(data.where("index_name = 'i0'").limit(5), path, by="index_name")
    assert {r[0]: r[1] for r in store.load(spark, path).groupBy("index_name").count().collect()} == {"i0": 5, "i1": 100}
    assert store.exists(spark, path) and store.delete(spark, path) and not store.exists(spark, path)
    store.save(store.metadata(spark, 42, 128, now=7), path + "-meta")
    assert store.load_metadata(spark, path + "-meta")["num_vectors"] == 42
    store.save(store.metadata(spark, 1, 2).selectExpr("9 as version", "num_vectors", "dimension", "created_at", "updated_at", "description"), path + "-bad")
    with pytest.raises(errors.StorageError):
        store.load_metadata(spark, path + "-bad")
