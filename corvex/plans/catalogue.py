"""All queries of the library's own operators, with their DuckDB twins.

``embeddings.label`` plays the index of a vector. Reports over pairs of vectors take as queries the rows whose id is
divisible by 50. Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.config import EXTENSIONS, GraphConfig, HnswConfig, QuantizerConfig
from corvex.functions import vectors as V
from corvex.operators import flat, graphs, hnsw, quantizer
from corvex.plans import knn, sync
from corvex.shared import table, written
from corvex.sources import corpus, repositories

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("idx_"), F.col("label").cast("string")).alias("index_name"))


def _zero(spark: SparkSession, d: str) -> list[float]:
    return knn.vector_of(table(spark, d, "embeddings"), 0)


_Q = "(select embedding::double[] from embeddings where vec_id = 0)"
_E = "list_transform(embedding, lambda x: x::double)"
_DIST = {
    "cosine": f"list_cosine_distance({_E}, {_Q})",
    "euclidean": f"list_distance({_E}, {_Q})",
    "dot": f"-list_dot_product({_E}, {_Q})",
    "manhattan": f"list_sum(list_transform(list_zip({_E}, {_Q}), lambda p: abs(p[1] - p[2])))",
}

# Distances and vector functions.
for _metric, _sql in _DIST.items():

    @query(f"select vec_id, round({_sql}, 6) as distance from embeddings", f"dist_{_metric}")
    def _(spark, d, metric=_metric):
        return table(spark, d, "embeddings").select("vec_id", _r(V.distance(metric, F.col("embedding"), V.literal(_zero(spark, d)))).alias("distance"))

    @query(f"select vec_id, round(({_sql}) ** 2, 6) as distance from embeddings", f"dist_squared_{_metric}")
    def _(spark, d, metric=_metric):
        return table(spark, d, "embeddings").select("vec_id", _r(V.squared_distance(metric, F.col("embedding"), V.literal(_zero(spark, d)))).alias("distance"))

    @query(f"select vec_id, round({_sql}, 6) as distance, row_number() over (order by {_sql}, vec_id)::int as rank from embeddings order by {_sql}, vec_id limit 10", f"knn_{_metric}_top10")
    def _(spark, d, metric=_metric):
        top = knn.search(table(spark, d, "embeddings"), _zero(spark, d), 10, metric)
        from pyspark.sql import Window

        return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", "vec_id"))).withColumn("distance", _r(F.col("distance")))  # ten rows


@query(f"select vec_id, list_transform({_E}, lambda x: round(x / sqrt(list_dot_product({_E}, {_E})), 6)) as unit, round(list_dot_product({_E}, {_E}), 6) as norm2 from embeddings")
def vec_normalize(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.normalized(e), lambda x: F.round(x, 6)).alias("unit"), _r(V.norm2(e)).alias("norm2"))


@query(f"select vec_id, round(list_cosine_similarity({_E}, {_Q}), 6) as similarity, round(list_dot_product({_E}, {_Q}), 6) as dot from embeddings")
def vec_similarity(spark, d):
    q = V.literal(_zero(spark, d))
    return table(spark, d, "embeddings").select("vec_id", _r(V.cosine_similarity(F.col("embedding"), q)).alias("similarity"), _r(V.dot(F.col("embedding"), q)).alias("dot"))


@query("select vec_id, len(embedding)::int as dim, list_transform(range(len(embedding)), lambda x: 0::float) as zeros from embeddings")
def vec_zeros(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.lit(0.0).cast("float")).alias("zeros"))


@query(f"select vec_id, round(1 / (1 + {_DIST['euclidean']}), 6) as similarity, round(1 - {_DIST['cosine']}, 6) as score from embeddings")
def vec_scores(spark, d):
    q = V.literal(_zero(spark, d))
    return table(spark, d, "embeddings").select("vec_id", _r(V.similarity(V.euclidean(F.col("embedding"), q))).alias("similarity"), _r(V.service_score(V.cosine(F.col("embedding"), q))).alias("score"))


# Exact search.
_PAIRS = """pairs as (select a.vec_id as q_id, 'idx_' || b.label as index_name, b.vec_id, list_cosine_distance(list_transform(b.embedding, lambda x: x::double), list_transform(a.embedding, lambda x: x::double)) as dist
  from embeddings a, embeddings b where a.vec_id % 50 = 0)"""


@query(f"with {_PAIRS} select q_id, vec_id, round(dist, 6) as distance, r::int as rank from (select *, row_number() over (partition by q_id order by round(dist, 9), vec_id) as r from pairs) where r <= 10")
def knn_batch(spark, d):
    e = table(spark, d, "embeddings")
    return knn.search_batch(e, knn.query_set(e)).withColumn("distance", _r(F.col("distance")))


@query(f"select * from (select vec_id, round({_DIST['cosine']}, 6) as distance from embeddings order by {_DIST['cosine']}, vec_id limit 50) where 1 / (1 + distance) >= 0.6")
def knn_threshold(spark, d):
    """The threshold holds after the 50 are taken."""
    return knn.search(table(spark, d, "embeddings"), _zero(spark, d), 50, min_similarity=0.6).withColumn("distance", _r(F.col("distance")))


@query(
    f"""with {_PAIRS}, tagged as (select *, row_number() over (partition by q_id, index_name order by round(dist, 9), vec_id) as i from pairs)
select q_id, index_name, vec_id, round(dist, 6) as distance, r::int as rank from (select *, row_number() over (partition by q_id order by round(dist, 9), vec_id) as r from tagged where i <= 10) where r <= 10"""
)
def knn_multi_index(spark, d):
    e = _vectors(spark, d)
    return knn.multi_index(e, knn.query_set(e)).withColumn("distance", _r(F.col("distance")))


@query(f"with {_PAIRS} select q_id, vec_id, round(dist, 6) as distance, r::int as rank from (select *, row_number() over (partition by q_id order by round(dist, 9), vec_id) as r from pairs where index_name in ('idx_1', 'idx_4')) where r <= 10")
def knn_index_subset(spark, d):
    e = _vectors(spark, d)
    return knn.search_batch(knn.in_indexes(e, ["idx_1", "idx_4", "idx_unknown"]), knn.query_set(e)).withColumn("distance", _r(F.col("distance")))


def _workspaces(spark, d) -> DataFrame:
    """One workspace for each provider of the catalogue."""
    c = table(spark, d, "index_catalog")
    return c.where("repository is not null and repository.provider is not null").groupBy(F.col("repository.provider").alias("name")).agg(F.collect_list("repository").alias("repositories"))


_NODES = """good as (select distinct on (node_id) node_id, index_name, vector from hnsw_nodes where len(vector) = 64 and list_count(vector) = 64 and not list_contains(list_transform(vector, lambda x: isnan(x)), true) order by node_id)"""


def _good_nodes(spark, d) -> DataFrame:
    return table(spark, d, "hnsw_nodes").where("node_id is not null and size(vector) = 64 and forall(vector, x -> x is not null and not isnan(x))").dropDuplicates(["node_id"])


_NODE_PAIRS = f"""{_NODES}, pairs as (select a.node_id as q_id, b.index_name, b.node_id,
  case when list_dot_product(a.vector::double[], a.vector::double[]) * list_dot_product(b.vector::double[], b.vector::double[]) = 0 then 1
  else 1 - list_dot_product(b.vector::double[], a.vector::double[]) / sqrt(list_dot_product(a.vector::double[], a.vector::double[]) * list_dot_product(b.vector::double[], b.vector::double[])) end as dist
  from good a, good b where a.node_id % 50 = 0)"""


@query(
    f"""with {_NODE_PAIRS}, wanted as (select distinct repository.provider || '/' || repository.full_name as index_name from index_catalog where repository.provider = 'gitlab')
select q_id, node_id, round(dist, 6) as distance from (select *, row_number() over (partition by q_id order by round(dist, 9), node_id) as r from pairs where index_name in (select index_name from wanted)) where r <= 5"""
)
def knn_workspace(spark, d):
    nodes = _good_nodes(spark, d)
    inside = knn.in_workspace(nodes, _workspaces(spark, d), "gitlab")
    top = knn.search_batch(inside, knn.query_set(nodes, id="node_id", vector="vector"), 6, id="node_id", vector="vector").where("rank <= 5")
    return top.select("q_id", "node_id", _r(F.col("distance")).alias("distance"))


@query(
    f"""with {_NODE_PAIRS}, tagged as (select *, row_number() over (partition by q_id, index_name order by round(dist, 9), node_id) as i from pairs), best as (select * from (select *, row_number() over (partition by q_id order by round(dist, 9), node_id) as r from tagged where i <= 10) where r <= 10)
select q_id, round(1 - dist, 6) as score, b.index_name as "index", path, left(content, 200) as snippet from best b join (select distinct file_id, path, content from stored_files) f on f.file_id = b.node_id"""
)
def service_search_hits(spark, d):
    nodes = _good_nodes(spark, d)
    top = knn.multi_index(nodes, knn.query_set(nodes, id="node_id", vector="vector"), 10, id="node_id", vector="vector", ties=9)
    # Each distinct file once, told apart by a hash of its content; no more than the snippet of it is shuffled.
    files = table(spark, d, "stored_files").select("file_id", "path", F.left("content", F.lit(200)).alias("content"), F.sha2("content", 256).alias("_c")).distinct()
    return knn.hits(top, files, id="node_id").withColumn("score", _r(F.col("score")))


@query(
    f"""with {_NODE_PAIRS}, best as (select q_id, b.index_name, path, content, round(1 - dist, 6) as score from (select *, row_number() over (partition by q_id order by round(dist, 9), node_id) as r from pairs) b
  join (select distinct file_id, path, content from stored_files) f on f.file_id = b.node_id where r <= 10),
r as (select *, row_number() over (partition by q_id order by score desc, index_name, path) as i from best)
select q_id, string_agg('[' || coalesce(index_name, '') || '] ' || coalesce(path, '') || chr(10) || coalesce(left(content, 200), ''), chr(10) || chr(10) order by i) as context from r where i <= 5 group by 1"""
)
def agent_context(spark, d):
    """The five best hits of each query as the context of a prompt."""
    return knn.context(service_search_hits(spark, d))


@query("select 'idx_' || label as index_name, count(*) as n_vectors from embeddings group by 1")
def index_vector_counts(spark, d):
    return _vectors(spark, d).groupBy("index_name").agg(F.count("*").alias("n_vectors"))


@query("select count(distinct label) as n_indexes, count(*) as n_vectors, avg(len(embedding)) as dim from embeddings")
def index_totals(spark, d):
    return table(spark, d, "embeddings").agg(F.count_distinct("label").alias("n_indexes"), F.count("*").alias("n_vectors"), F.avg(F.size("embedding")).alias("dim"))


# Graphs.
_EDGES = """edges as (select distinct src, dst from (select node_id as src, unnest(layer_list) as dst from (select node_id, unnest(connections) as layer_list from hnsw_nodes)) where src is not null and dst is not null and src <> dst and dst in (select node_id from hnsw_nodes))"""


def _edges(spark, d) -> DataFrame:
    nodes = table(spark, d, "hnsw_nodes")
    return graphs.existing(graphs.edges_of(nodes), nodes).select("src", "dst").distinct()


@query("select layer, src, dst from (select node_id as src, (i - 1)::int as layer, unnest(connections[i]) as dst from (select node_id, connections, unnest(range(1, len(connections) + 1)) as i from hnsw_nodes)) where dst is not null and src <> dst group by all")
def graph_edges(spark, d):
    return graphs.edges_of(table(spark, d, "hnsw_nodes"))


@query(f"with {_EDGES} select src, dst from edges union select dst, src from edges")
def graph_symmetric(spark, d):
    return graphs.symmetric(_edges(spark, d))


@query(f"with {_EDGES} select src as node_id, count(*) as degree from edges group by 1")
def graph_degree(spark, d):
    return graphs.degrees(_edges(spark, d))


@query(f"with {_EDGES} select src as node_id, list(dst order by dst) as neighbors, count(*)::int as degree from edges group by 1")
def graph_adjacency(spark, d):
    return graphs.adjacency(_edges(spark, d))


@query(f"with {_EDGES}, d as (select src as node_id, count(*)::int as degree from edges group by 1) select node_id, degree, (sum(degree) over (order by node_id) - degree)::bigint as \"offset\" from d")
def graph_csr_offsets(spark, d):
    return graphs.offsets(graphs.adjacency(_edges(spark, d)).drop("neighbors"))


@query(f"with {_EDGES}, n as (select count(distinct node_id) as n from hnsw_nodes), e as (select count(*) as e from edges) select (8 * (n + 1 + e + n + n))::bigint as n_bytes from n, e")
def graph_storage_bytes(spark, d):
    n, e = table(spark, d, "hnsw_nodes").select("node_id").distinct().count(), _edges(spark, d)
    return e.agg(graphs.storage_bytes(F.lit(n), F.count("*")).cast("bigint").alias("n_bytes"))


_WEIGHTED = f"""{_EDGES}, {_NODES}, weighted as (select src, dst, case when list_dot_product(a.vector::double[], a.vector::double[]) * list_dot_product(b.vector::double[], b.vector::double[]) = 0 then 1.0 else
  1 - list_dot_product(a.vector::double[], b.vector::double[]) / sqrt(list_dot_product(a.vector::double[], a.vector::double[]) * list_dot_product(b.vector::double[], b.vector::double[])) end as dist
  from edges join good a on a.node_id = src join good b on b.node_id = dst)"""


def _weighted(spark, d) -> DataFrame:
    return graphs.weighted(_edges(spark, d), _good_nodes(spark, d))


@query(f"with {_WEIGHTED} select src, dst, round(dist, 6) as dist from (select *, row_number() over (partition by src order by dist, dst) as r from weighted) where r <= 4")
def graph_closest(spark, d):
    return graphs.closest(_weighted(spark, d), 4).withColumn("dist", _r(F.col("dist")))


@query(
    f"""with {_WEIGHTED}, deg as (select src as dst, count(*) as deg from weighted group by 1), c as (select w.*, coalesce(deg, 0) as deg from weighted w left join deg using (dst)),
r as (select *, count(*) over (partition by src) as n, row_number() over (partition by src order by deg desc, dst) as i from c),
t as (select *, max(case when ceil(n * 0.3) > 0 and ceil(n * 0.3) < n and i = ceil(n * 0.3) then deg end) over (partition by src) as least from r), h as (select *, coalesce(deg >= least, false) as hub from t),
k as (select *, case when hub and row_number() over (partition by src, hub order by deg desc, dst) <= 1 then 0 when not hub then 1 else 2 end as class from h),
p as (select *, row_number() over (partition by src order by class, case when class = 1 then dist else -deg end, dst) as place from k)
select src, dst, round(dist, 6) as dist from p where n <= 5 or place <= 5"""
)
def hub_preserving_prune(spark, d):
    return graphs.hub_preserving(_weighted(spark, d), 5, 0.3).withColumn("dist", _r(F.col("dist")))


@query(f"with {_EDGES}, deg as (select src as node_id, count(*) as degree from edges group by 1) select node_id, degree from deg where degree >= (select quantile_disc(degree, 0.98) from deg)")
def hub_nodes(spark, d):
    return graphs.global_hubs(_edges(spark, d), 0.02)


@query(
    """select distinct node_id, least(floor(-ln((('0x' || substr(md5(node_id::varchar), 1, 8))::ubigint::bigint + 1) / 4294967297.0) / ln(30)), 15)::int as level from hnsw_nodes where node_id is not null"""
)
def node_levels(spark, d):
    return table(spark, d, "hnsw_nodes").where("node_id is not null").select("node_id", graphs.level("node_id").alias("level")).distinct()


@query("select node_id, level from hnsw_nodes where level is not null order by level desc, node_id limit 1")
def entry_point(spark, d):
    return graphs.entry_point(table(spark, d, "hnsw_nodes"))


for _ratio, _kind in ((0.3, "local"), (0.5, "global")):

    @query(
        f"""with {_EDGES}, adj as (select src as node_id, list(dst order by dst) as l from edges group by 1)
select node_id, l[1:greatest(1, ceil(len(l) * (1 - {"0.5 * " if _kind == "global" else ""}{_ratio})))::int] as kept from adj""",
        f"prune_{_kind}",
    )
    def _(spark, d, ratio=_ratio, kind=_kind):
        config = GraphConfig(prune_ratio=ratio, pruning=kind)
        return graphs.adjacency(_edges(spark, d)).select("node_id", graphs.prune(F.col("neighbors"), config, F.lit(32)).alias("kept"))


@query(
    f"""with {_EDGES}, deg as (select src as dst, count(*) as deg from edges group by 1), l as (select src, e.dst, coalesce(deg, 0) as deg from edges e left join deg using (dst)),
w as (select *, sum(deg) over (partition by src) as total, greatest(1, ceil(count(*) over (partition by src) * 0.5)) as keep, row_number() over (partition by src order by dst) as i,
  (('0x' || substr(md5(src || '/' || dst), 1, 8))::ubigint::bigint + 1) / 4294967297.0 as u from l),
c as (select *, case when total = 0 then i <= keep else u < deg / total::double * keep end as kept from w), n as (select *, sum(kept::int) over (partition by src order by dst) as place, sum(kept::int) over (partition by src) as n_kept from c)
select src as node_id, list(dst order by dst) as kept from n where (kept and place <= keep) or (n_kept = 0 and i = 1) group by 1"""
)
def prune_proportional(spark, d):
    config = GraphConfig(prune_ratio=0.5, pruning="proportional")
    edges = _edges(spark, d)
    rows = edges.join(graphs.degrees(edges).withColumnRenamed("node_id", "dst"), "dst", "left").groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("dst", F.coalesce("degree", F.lit(0)).alias("deg")))).alias("l"))
    return rows.select("node_id", graphs.prune(F.transform("l", lambda x: x["dst"]), config, salt=F.col("node_id"), degree=F.transform("l", lambda x: x["deg"])).alias("kept"))


@query(
    f"""with {_EDGES}, h0 as (select distinct node_id from hnsw_nodes where node_id % 50 = 0), h1 as (select distinct dst as node_id from edges join h0 on src = node_id where dst not in (select node_id from h0)),
h2 as (select distinct dst as node_id from edges join h1 on src = node_id where dst not in (select node_id from h0) and dst not in (select node_id from h1))
select node_id, 0 as hop from h0 union all select node_id, 1 from h1 union all select node_id, 2 from h2"""
)
def graph_reach_2hop(spark, d):
    return graphs.reachable(_edges(spark, d), table(spark, d, "hnsw_nodes").where("node_id % 50 = 0"), 2)


@query()
def hnsw_search(spark, d):
    e = _vectors(spark, d)
    graph = written(hnsw.build_layered(e, HnswConfig(), index="index_name"), "graph")
    return hnsw.search_layered(graph, knn.query_set(e), 10, 100).withColumn("distance", _r(F.col("distance")))


@query()
def hnsw_recall(spark, d):
    e = _vectors(spark, d)
    found = hnsw_search(spark, d).withColumnRenamed("id", "vec_id")
    return knn.recall(found, knn.search_batch(e, knn.query_set(e)))


@query()
def graph_beam_search(spark, d):
    """Over the stored connections, with vectors fetched for the expanded nodes alone."""
    nodes, links = _good_nodes(spark, d).where("exists(vector, x -> x <> 0)"), written(graphs.adjacency(graphs.symmetric(_edges(spark, d))), "links")
    start = nodes.agg(F.min_by("node_id", F.struct(-F.col("level"), F.col("node_id")))).first()[0]
    out, _ = hnsw.beam_search(links, nodes, knn.query_set(nodes, id="node_id", vector="vector"), start, config=GraphConfig(ef_search=32, beam_width=8, prune_ratio=0.3))
    return out.withColumn("distance", _r(F.col("distance")))


@query(
    f"""with {_WEIGHTED}, deg as (select src, count(*) as n from weighted group by 1), hubs as (select src from deg where n >= 6)
select src, dst, round(dist, 6) as dist from (select w.*, row_number() over (partition by src order by dist, dst) as r, src in (select src from hubs) as hub from weighted w) where r <= case when hub then 6 else 3 end"""
)
def degree_cap(spark, d):
    """Nodes of at least six links keep six, the others three."""
    w = _weighted(spark, d)
    return graphs.by_degree(w, graphs.degrees(w).where("degree >= 6"), 6, 3).withColumn("dist", _r(F.col("dist")))


# Flat graphs built here; an index of embeddings is a shard, as none has more than 4,096 vectors in these tables.
_FLAT = GraphConfig(m=8, m0=16, ef_construction=64)
_KNN_EDGES = """pairs as (select a.vec_id as src, b.vec_id as dst, list_cosine_distance(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) as dist
  from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id),
near as (select src, dst, dist from (select *, row_number() over (partition by src order by round(dist, 9), dst) as r from pairs) where r <= 8)"""


@query(f"with {_KNN_EDGES} select src, dst, round(dist, 6) as dist from near")
def graph_nearest_edges(spark, d):
    return flat.nearest_edges(_vectors(spark, d), _FLAT, index="index_name").withColumn("dist", _r(F.col("dist")))


@query(
    f"""with {_KNN_EDGES}, weighted as (select src, dst, min(dist) as dist from (select * from near union all select dst, src, dist from near) group by 1, 2),
deg as (select src as dst, count(*) as deg from weighted group by 1), c as (select w.*, coalesce(deg, 0) as deg from weighted w left join deg using (dst)),
r as (select *, count(*) over (partition by src) as n, row_number() over (partition by src order by deg desc, dst) as i from c),
t as (select *, max(case when ceil(n * 0.02) > 0 and ceil(n * 0.02) < n and i = ceil(n * 0.02) then deg end) over (partition by src) as least from r), h as (select *, coalesce(deg >= least, false) as hub from t),
k as (select *, case when hub and row_number() over (partition by src, hub order by deg desc, dst) <= 4 then 0 when not hub then 1 else 2 end as class from h),
p as (select *, row_number() over (partition by src order by class, case when class = 1 then dist else -deg end, dst) as place from k)
select src as node_id, list(dst order by dst) as neighbors, count(*)::int as degree from p where n <= 16 or place <= 16 group by 1"""
)
def graph_exact(spark, d):
    """Each index's exact neighbours both ways, capped with hubs kept."""
    return flat.build_exact(_vectors(spark, d), _FLAT, index="index_name").withColumn("neighbors", F.array_sort("neighbors"))


def _flat(spark, d) -> DataFrame:
    return written(flat.build(_vectors(spark, d), _FLAT, index="index_name"), "flat")


@query("select count(*) as n_nodes, count(distinct label) as n_entries, true as within_cap from embeddings")
def graph_build(spark, d):
    """Graphs built node by node: one of each index, no list longer than m0."""
    return _flat(spark, d).agg(F.count("*").alias("n_nodes"), F.count_if("is_entry").alias("n_entries"), (F.max("degree") <= _FLAT.m0).alias("within_cap"))


def _enough(recall: DataFrame, n: int) -> DataFrame:
    return recall.select(F.lit(n).cast("bigint").alias("n_queries"), (F.col("recall") >= 0.9).alias("recall_is_enough"))


_ENOUGH = "select count(*) as n_queries, true as recall_is_enough from embeddings where vec_id % 50 = 0"


@query(_ENOUGH)
def graph_build_recall(spark, d):
    """Searches that begin at every index's entry and fetch vectors only for what they expand, against exact search."""
    e, graph = _vectors(spark, d), _flat(spark, d)
    asked = knn.query_set(e)
    found, _ = hnsw.beam_search(graph, e, asked, flat.entries(graph), 10, GraphConfig(ef_search=96, beam_width=24), id="vec_id", vector="embedding")
    return _enough(knn.recall(found, knn.search_batch(e, asked)), asked.count())


@query(_ENOUGH)
def hnsw_recall_is_enough(spark, d):
    e = _vectors(spark, d)
    return _enough(hnsw_recall(spark, d), knn.query_set(e).count())


# Product quantization.
_PQ = QuantizerConfig(subquantizers=8, centroids=16, iterations=10, seed=1)
_BOOK = "book as (select s::int as sq, (c - 1)::int as code, list_transform(embedding[s * 8 + 1:s * 8 + 8], lambda x: x::double) as centroid from (select embedding, row_number() over (order by vec_id) as c from embeddings), range(8) t(s) where c <= 16)"
_SUBS = "subs as (select vec_id, s::int as sq, list_transform(embedding[s * 8 + 1:s * 8 + 8], lambda x: x::double) as sub from embeddings, range(8) t(s))"
_SQ = "list_sum(list_transform(list_zip(sub, centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_CODES = f"{_BOOK}, {_SUBS}, near as (select vec_id, sq, code, centroid, sub, {_SQ} as d2 from subs join book using (sq)), codes as (select vec_id, sq, code, centroid, sub from (select *, row_number() over (partition by vec_id, sq order by round(d2, 12), code) as r from near) where r = 1)"
_ADC = f"{_CODES}, adc as (select vec_id, sqrt(sum({_SQ.replace('sub,', 'q.sub,').replace('(sub', '(q.sub')})) as distance from codes join (select sq, sub from subs where vec_id = 0) q using (sq) group by 1)"


def _book(spark, d) -> DataFrame:
    return quantizer.first_codebook(table(spark, d, "embeddings"), _PQ, 64)


def _coded(spark, d) -> DataFrame:
    return quantizer.encode(table(spark, d, "embeddings"), _book(spark, d), _PQ)


@query("select vec_id, s::int as sq, embedding[s * 8 + 1:s * 8 + 8] as sub from embeddings, range(8) t(s)")
def pq_subvectors(spark, d):
    return quantizer.subvectors(table(spark, d, "embeddings"), _PQ, 64)


@query(f"with {_CODES} select vec_id, list(code order by sq) as codes from codes group by 1")
def pq_encode(spark, d):
    return _coded(spark, d)


@query(f"with {_CODES} select vec_id, sq, code from codes")
def pq_assign(spark, d):
    return quantizer.assign(quantizer.subvectors(table(spark, d, "embeddings"), _PQ, 64), _book(spark, d)).drop("d2")


@query(f"with {_CODES} select vec_id, list_transform(flatten(list(centroid order by sq)), lambda x: round(x, 6)) as decoded from codes group by 1")
def pq_decode(spark, d):
    return quantizer.decode(_coded(spark, d), _book(spark, d)).select("vec_id", F.transform("decoded", lambda x: F.round(x, 6)).alias("decoded"))


@query(f"with {_BOOK}, {_SUBS} select sq, code, round({_SQ}, 6) as d2 from book join subs using (sq) where vec_id = 0")
def pq_distance_table(spark, d):
    return quantizer.distance_table(_book(spark, d), _zero(spark, d), _PQ).withColumn("d2", _r(F.col("d2")))


@query(f"with {_ADC} select vec_id, round(distance, 6) as distance from adc order by adc.distance, vec_id limit 10")
def pq_adc_top10(spark, d):
    return quantizer.asymmetric(_coded(spark, d), _book(spark, d), _zero(spark, d), _PQ).orderBy("distance", "vec_id").limit(10).withColumn("distance", _r(F.col("distance")))


@query(f"with {_CODES} select vec_id, round(sqrt(sum({_SQ})), 6) as error from codes group by 1")
def pq_recon_error(spark, d):
    e = table(spark, d, "embeddings")
    return quantizer.reconstruction_error(e, quantizer.decode(_coded(spark, d), _book(spark, d))).withColumn("error", _r(F.col("error")))


@query("select 8 as bytes_per_vector, 32.0::double as ratio")
def pq_compression(spark, d):
    return spark.range(1).select(F.lit(_PQ.bytes_per_vector).alias("bytes_per_vector"), F.lit(_PQ.compression(64)).alias("ratio"))


@query(
    f"""with {_CODES}, means as (select sq, code, i, avg(sub[i]) as m from (select sq, code, sub, unnest(range(1, 9)) as i from codes) group by all), new as (select sq, code, list(m order by i) as c from means group by all)
select sq, code, list_transform(coalesce(c, centroid), lambda x: round(x, 6)) as centroid from book left join new using (sq, code)"""
)
def pq_lloyd_step(spark, d):
    subs = quantizer.subvectors(table(spark, d, "embeddings"), _PQ, 64)
    return quantizer.lloyd_step(subs, _book(spark, d)).select("sq", "code", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query()
def pq_train(spark, d):
    book = quantizer.train(table(spark, d, "embeddings"), _PQ, 64)
    return book.select("sq", "code", F.transform("centroid", lambda x: F.round(x, 4)).alias("centroid"))


@query(f"with {_ADC}, first as (select vec_id from adc order by distance, vec_id limit 100) select vec_id, round({_DIST['cosine']}, 6) as distance from embeddings where vec_id in (select vec_id from first) order by {_DIST['cosine']}, vec_id limit 10")
def two_level_search(spark, d):
    e = table(spark, d, "embeddings")
    return quantizer.two_level(e, _coded(spark, d), _book(spark, d), _zero(spark, d), _PQ).withColumn("distance", _r(F.col("distance")))


@query("select count(*) as n_codes, true as better_than_untrained from embeddings")
def pq_trained_error(spark, d):
    """Codes of a trained codebook; their mean error is below that of the first vectors as a codebook."""
    e = table(spark, d, "embeddings")
    book = written(quantizer.train(e, _PQ, 64), "book")
    codes = written(quantizer.encode(e, book, _PQ), "codes")
    mean = lambda c, b: quantizer.reconstruction_error(e, quantizer.decode(c, b)).agg(F.avg("error")).first()[0]
    good = mean(codes, book) < mean(_coded(spark, d), _book(spark, d))
    return codes.agg(F.count("*").alias("n_codes"), F.lit(good).alias("better_than_untrained"))


@query(_ENOUGH)
def two_level_recall(spark, d):
    """Of 10 neighbours those that a trained codebook brings among its nearest fifth, ranked again exactly."""
    e = table(spark, d, "embeddings")
    asked = knn.query_set(e)
    book = written(quantizer.train(e, QuantizerConfig(subquantizers=8, centroids=64, iterations=10, seed=1), 64), "book")
    found = quantizer.two_level_batch(e, quantizer.encode(e, book, _PQ), book, asked, _PQ, 10, 0.2)
    return _enough(knn.recall(found, knn.search_batch(e, asked)), asked.count())


# Corpus.
_EXT = r"regexp_extract(path, '[^/]\.([^./]+)$', 1)"
_VISIBLE = "not list_contains(list_transform(string_split(path, '/'), lambda p: starts_with(p, '.') or p in ('node_modules', 'target')), true)"


@query(f"select distinct file_id, index_name, path from stored_files where {_VISIBLE} and {_EXT} in {EXTENSIONS}")
def corpus_scan(spark, d):
    f = table(spark, d, "stored_files")
    return f.where(corpus.visible(F.col("path")) & corpus.has_extension(F.col("path"), EXTENSIONS)).select("file_id", "index_name", "path").distinct()


@query(f"select {_EXT} as extension, count(*) as n_files from stored_files where path is not null group by 1")
def corpus_extensions(spark, d):
    return corpus.counts_by_extension(table(spark, d, "stored_files").where("path is not null"))


@query(
    """select distinct file_id, left(content, 200) as snippet, left(content, 100) as preview, case when length(content) > 500 then left(content, 500) || '...' else content end as shortened, left(content, 1000) as prompt from stored_files"""
)
def corpus_snippets(spark, d):
    c = F.col("content")
    return table(spark, d, "stored_files").select("file_id", corpus.snippet(c).alias("snippet"), corpus.snippet(c, 100).alias("preview"), corpus.shortened(c).alias("shortened"), F.left(c, F.lit(1000)).alias("prompt")).distinct()


@query(
    """select file_id, i::int as chunk_no, substr(content, i * 448 + 1, 512) as chunk from (select *, unnest(range(0, greatest(1, ceil((length(content) - 64) / 448.0)::int))) as i from (select distinct file_id, content from stored_files where length(content) > 0))"""
)
def corpus_chunks(spark, d):
    return corpus.chunks(table(spark, d, "stored_files").dropDuplicates(["file_id"]))


@query(
    """select doc_id, ((('0x' || substr(md5(word), 1, 8))::ubigint::bigint) % 64)::int as bucket, count(*) as n from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as word from documents) where word <> '' group by all"""
)
def hash_embed(spark, d):
    return corpus.hash_embedding(table(spark, d, "documents"))


@query(
    """with words as (select doc_id, ((('0x' || substr(md5(word), 1, 8))::ubigint::bigint) % 64)::int as b from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as word from documents) where word <> ''),
v as (select doc_id, b, count(*) as n from words group by all), l as (select doc_id, sqrt(sum(n * n)) as len from v group by 1),
s as (select a.doc_id as q_id, b.doc_id, sum(a.n * b.n) / (max(x.len) * max(y.len)) as score from v a join v b using (b) join l x on x.doc_id = a.doc_id join l y on y.doc_id = b.doc_id where a.doc_id % 50 = 0 and a.doc_id <> b.doc_id group by all)
select q_id, doc_id, round(score, 6) as score from (select *, row_number() over (partition by q_id order by round(score, 9) desc, doc_id) as r from s) where r <= 5"""
)
def corpus_semantic_search(spark, d):
    """The five documents most similar to each stated one by hashed words."""
    dense = written(corpus.hashed_counts(table(spark, d, "documents")).where("exists(v, x -> x > 0)"), "dense")
    # One more than wanted, as each query finds itself; scores that are equal when rounded are ties, by id.
    top = knn.search_batch(dense, knn.query_set(dense, id="doc_id", vector="v"), 6, id="doc_id", vector="v", digits=9).where("q_id <> doc_id")
    from pyspark.sql import Window

    ranked = top.withColumn("r", F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "doc_id"))).where("r <= 5")
    return ranked.select("q_id", "doc_id", F.round(1 - F.col("distance"), 6).alias("score"))


# Repositories.
@query(
    r"""select name, clone_url, case when clone_url like 'git@%' then lower(regexp_extract(clone_url, '^[\w.-]+@([^:/]+):', 1)) else lower(regexp_extract(clone_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/]*@)?([^:/?#]+)', 1)) end as host,
regexp_replace(regexp_extract(clone_url, '^[a-zA-Z]+://[^/]+/(.*)$', 1), '(\.git)?/*$', '') as path,
case when lower(clone_url) like '%github%' then 'github' when lower(clone_url) like '%gitlab%' then 'gitlab' when lower(clone_url) like '%bitbucket%' then 'bitbucket' else 'gitea' end as provider
from (select name, repository.clone_url as clone_url from index_catalog where repository.clone_url is not null)"""
)
def repository_urls(spark, d):
    u = F.col("clone_url")
    rows = table(spark, d, "index_catalog").select("name", F.col("repository.clone_url").alias("clone_url")).where("clone_url is not null")
    return rows.select("name", u, repositories.host_of(u).alias("host"), repositories.path_of(u).alias("path"), repositories.detect_provider(u).alias("provider"))


@query(
    """select name, repository.provider || '/' || repository.full_name as index_name, '/data/' || repository.provider || '/' || repository.owner || '/' || repository.name || '/index.graph' as index_path,
case when repository.provider = 'gitlab' then replace(repository.clone_url, 'https://', 'https://oauth2:TOK@') else replace(repository.clone_url, 'https://', 'https://TOK@') end as authorized,
round(size_bytes / 1048576, 2) as megabytes from index_catalog where repository.provider is not null and repository.full_name is not null and repository.owner is not null and repository.name is not null"""
)
def repository_identity(spark, d):
    rows = table(spark, d, "index_catalog").where("repository.provider is not null and repository.full_name is not null and repository.owner is not null and repository.name is not null")
    p = F.col("repository.provider")
    return rows.select(
        "name",
        repositories.index_name(p, F.col("repository.full_name")).alias("index_name"),
        repositories.index_path("/data", p, F.col("repository.owner"), F.col("repository.name")).alias("index_path"),
        repositories.with_token(F.col("repository.clone_url"), p, F.lit("TOK")).alias("authorized"),
        sync.megabytes(F.col("size_bytes")).alias("megabytes"),
    )


_LISTED = "record_id, provider, owner, name, full_name, clone_url, ssh_url, default_branch, size_kb, is_private, topics"
_LISTING = f"""select distinct {_LISTED} from (
select record_id, 'gitea' as provider, coalesce(owner.login, owner.username, split_part(full_name, '/', 1)) as owner, name, full_name, clone_url, ssh_url, coalesce(default_branch, 'main') as default_branch, coalesce(size, 0) as size_kb, coalesce(private, false) as is_private, coalesce(topics, []::varchar[]) as topics from gitea_repos
union all select record_id, 'gitlab', coalesce(namespace.full_path, namespace.path), path, path_with_namespace, http_url_to_repo, ssh_url_to_repo, coalesce(default_branch, 'main'), coalesce(statistics.repository_size // 1024, 0), coalesce(visibility <> 'public', false), coalesce(topics, []::varchar[]) from gitlab_projects
union all select record_id, 'bitbucket', coalesce(owner.username, workspace.slug), slug, full_name, list_filter(links.clone, lambda x: x.name = 'https')[1].href, list_filter(links.clone, lambda x: x.name = 'ssh')[1].href, coalesce(mainbranch.name, 'main'), coalesce(size // 1024, 0), coalesce(is_private, false), []::varchar[] from bitbucket_repos)"""


@query(_LISTING)
def repository_listing(spark, d):
    rows = repositories.from_gitea(table(spark, d, "gitea_repos")).unionByName(repositories.from_gitlab(table(spark, d, "gitlab_projects"))).unionByName(repositories.from_bitbucket(table(spark, d, "bitbucket_repos")))
    return rows.select(*(x.strip() for x in _LISTED.split(","))).distinct()


@query("select provider, count(*) as n, count(case when is_private then 1 end) as n_private, sum(size_kb)::bigint as size_kb from (" + _LISTING + ") group by 1")
def repository_totals(spark, d):
    return repository_listing(spark, d).groupBy("provider").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_private"), 1)).alias("n_private"), F.sum("size_kb").alias("size_kb"))


@query(
    """select distinct event_id, replace(lower(event_type), ' ', '_') as kind, repository.provider as provider, ref_name, before, after from webhook_events where replace(lower(event_type), ' ', '_') in ('push', 'push_hook', 'repo:push')"""
)
def webhook_pushes(spark, d):
    rows = table(spark, d, "webhook_events").where(repositories.is_push(F.col("event_type")))
    return rows.select("event_id", repositories.event_kind(F.col("event_type")).alias("kind"), F.col("repository.provider").alias("provider"), "ref_name", "before", "after").distinct()


@query("select repo_key, after from (select repository.full_name as repo_key, after, row_number() over (partition by repository.full_name order by sent_at desc, event_id desc) as r from webhook_events where after is not null and repository.full_name is not null) where r = 1")
def latest_commits(spark, d):
    rows = table(spark, d, "webhook_events").where("after is not null and repository.full_name is not null")
    return rows.groupBy(F.col("repository.full_name").alias("repo_key")).agg(F.max_by("after", F.struct(F.coalesce("sent_at", F.lit(0).cast("timestamp")), "event_id")).alias("after"))


@query(
    """select name, repository.default_branch as default_branch, case lower(repository.provider) when 'github' then 'github' when 'gh' then 'github' when 'gitlab' then 'gitlab' when 'gl' then 'gitlab' when 'bitbucket' then 'bitbucket' when 'bb' then 'bitbucket'
when 'gitea' then 'gitea' when 'forgejo' then 'gitea' when 'gogs' then 'gitea' end as provider from index_catalog where repository is not null"""
)
def repository_branches(spark, d):
    return table(spark, d, "index_catalog").where("repository is not null").select("name", F.col("repository.default_branch").alias("default_branch"), repositories.provider_of(F.col("repository.provider")).alias("provider"))


@query("select event_id, event_type, (props::json->>'k')::bigint as k from events")
def event_fields(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))


# Catalogue and sync.
@query("select count(*) as n_indexes, coalesce(sum(file_count), 0)::bigint as n_files, coalesce(sum(size_bytes), 0)::bigint as n_bytes from index_catalog")
def catalogue_totals(spark, d):
    return sync.totals(table(spark, d, "index_catalog"))


_LATEST = "latest as (select * from (select *, row_number() over (partition by repo_key order by coalesce(recorded_at, '1970-01-01'::timestamptz) desc, state_id desc) as r from (select distinct * from repository_states) where repo_key is not null) where r = 1)"


@query(f"with {_LATEST} select repo_key, state_id, last_commit, (not coalesce(indexed, false) or error is not null) as needs_reindex from latest")
def sync_state_latest(spark, d):
    s = sync.latest_states(table(spark, d, "repository_states"))
    return s.select("repo_key", "state_id", "last_commit", sync.needs_reindex(F.col("indexed"), F.col("error")).alias("needs_reindex"))


@query(f"with {_LATEST} select c.name, coalesce(c.file_count, 0) as file_count, coalesce(l.indexed, false) as indexed, l.error from index_catalog c left join latest l on l.repo_key = c.name")
def index_status(spark, d):
    return sync.status(table(spark, d, "index_catalog"), sync.latest_states(table(spark, d, "repository_states"))).drop("last_synced")


@query(
    """select repo_key, state_id, before, after from (select repo_key, state_id, last_commit as after, lag(last_commit) over (partition by repo_key order by recorded_at nulls first, state_id) as before
from (select distinct on (repo_key, state_id) * from repository_states where repo_key is not null and last_commit is not null)) where before is distinct from after"""
)
def commit_changes(spark, d):
    return sync.commit_changes(table(spark, d, "repository_states"))


@query(
    """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events where user_id is not null and ts is not null),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from e) select user_id, min(ts) as started, max(ts) as last_event, count(*) as n_events from s group by user_id, s"""
)
def debounce_sessions(spark, d):
    return sync.debounced(table(spark, d, "events"), "user_id", "ts", 1800)


@query("select user_id, time_bucket(interval 1 hour, ts) as window_start, count(*) as n_events, count(*) > 3 as over_limit from events group by 1, 2")
def rate_windows(spark, d):
    return sync.rate_windows(table(spark, d, "events"), "user_id", "ts", 3600, 3)


@query(
    """select distinct file_id, '/data/repos/' || index_name as root from stored_files where path is not null and index_name is not null and not contains('/data/repos/' || index_name || '/' || path, '.git')"""
)
def watched_roots(spark, d):
    rows = table(spark, d, "stored_files").select("file_id", sync.watched_root(F.concat_ws("/", F.lit("/data/repos"), F.when(F.col("path").isNotNull(), F.col("index_name")), "path"), "/data/repos").alias("root"))
    return rows.where("root is not null").distinct()


@query("select user_id, string_agg(event_type, chr(10) order by ts, event_id) as context from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 10 group by 1")
def last_turns(spark, d):
    return sync.last_turns(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
