"""Graph indexes built and searched in numpy inside Spark tasks: layered (HNSW) and flat with recomputed vectors.

A graph is built for each shard, and a shard has a bounded number of vectors, so no task's group grows with the corpus:
vectors are spread over shards by the hash of their id within their index. A search visits all shards and merges.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import md5
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvex.config import GraphConfig, HnswConfig
from corvex.errors import DimensionMismatch, IndexNotBuilt
from corvex.plans.knn import BLOCK, distances
from corvex.shared import freed, written

SHARD = 4096  # vectors of a shard, about


def seeded_level(id: int, factor: float, max_layers: int) -> int:
    u = (int(md5(str(id).encode()).hexdigest()[:8], 16) + 1) / 4294967297.0
    return min(int(-log(u) * factor), max_layers - 1)


@dataclass
class Layered:
    """The graph of one shard; new nodes count among the candidates when full lists are cut."""

    config: HnswConfig
    ids: list[int] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)
    links: list[list[list[int]]] = field(default_factory=list)
    entry: int = -1
    x: np.ndarray | None = None

    def _d(self, q: np.ndarray, at: list[int]) -> np.ndarray:
        return distances(self.config.metric, q[None], self.x[at])[0]

    def _layer(self, q: np.ndarray, entries: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        seen = set(entries)
        first = sorted(zip(self._d(q, entries), entries))
        todo, best = list(first), [(-d, -i) for d, i in first]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in (self.links[i][layer] if layer < len(self.links[i]) else ()) if j not in seen]
            seen.update(new)
            for e, j in zip(self._d(q, new), new) if new else ():
                if len(best) < ef or e < -best[0][0]:
                    heapq.heappush(todo, (e, j))
                    heapq.heappush(best, (-e, -j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def add(self, id: int) -> None:
        n, level = len(self.ids), seeded_level(id, self.config.level_factor, self.config.max_layers)
        self.ids.append(id)
        self.levels.append(level)
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = n
            return
        q, at = self.x[n], [self.entry]
        top = self.levels[self.entry]
        for layer in range(top, level, -1):
            at = [self._layer(q, at, 1, layer)[0][1]]
        for layer in range(min(level, top), -1, -1):
            most = self.config.m0 if layer == 0 else self.config.m
            near = self._layer(q, at, self.config.ef_construction, layer)
            at = [i for _, i in near]
            self.links[n][layer] = at[:most]
            for i in at[:most]:
                back = self.links[i][layer]
                back.append(n)
                if len(back) > most:
                    d = self._d(self.x[i], back)
                    self.links[i][layer] = [back[j] for j in np.lexsort((back, d))[:most]]
        if level > top:
            self.entry = n

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[int, float]]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for layer in range(self.levels[self.entry], 0, -1):
            at = [self._layer(q, at, 1, layer)[0][1]]
        return [(self.ids[i], float(d)) for d, i in self._layer(q, at, max(ef, k), 0)[:k]]


def with_shards(vectors: DataFrame, id: str, vector: str, index: str | None) -> DataFrame:
    """(shard, _id, _v): each index's vectors over as many shards as its number of rows asks for."""
    rows = vectors.where(F.col(vector).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("_id"), F.col(vector).alias("_v"), (F.col(index).cast("string") if index else F.lit("")).alias("_x"))
    parts = rows.groupBy(F.col("_x").alias("_y")).agg(F.ceil(F.count("*") / SHARD).cast("int").alias("_parts"))
    return rows.join(parts, F.col("_x").eqNullSafe(F.col("_y"))).select(F.concat_ws("#", "_x", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("string")).alias("shard"), "_id", "_v")


def build_layered(vectors: DataFrame, config: HnswConfig | None = None, id: str = "vec_id", vector: str = "embedding", index: str | None = None) -> DataFrame:
    """(shard, id, vector, level, connections, is_entry): the graphs of all shards, one row a node.

    Nodes are inserted by id and levels come from ids, so a build repeats exactly. Vectors of different dimension
    within a shard fail the build; null vectors take no part; a repeated id counts once.
    """
    config = config or HnswConfig()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id").drop_duplicates("_id")
        sizes = {len(v) for v in pdf["_v"]}
        if len(sizes) > 1:
            raise DimensionMismatch(*sorted(sizes)[:2])
        g = Layered(config)
        g.x = np.array(pdf["_v"].tolist(), dtype=np.float64)
        for i in pdf["_id"]:
            g.add(int(i))
        links = [[[g.ids[j] for j in layer] for layer in node] for node in g.links]
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "id": g.ids, "vector": pdf["_v"].to_numpy(), "level": g.levels, "connections": links, "is_entry": [i == g.entry for i in range(len(g.ids))]})

    schema = "shard string, id long, vector array<float>, level int, connections array<array<long>>, is_entry boolean"
    return with_shards(vectors, id, vector, index).groupBy("shard").applyInPandas(build, schema)


def search_layered(graph: DataFrame, queries: DataFrame, k: int = 10, ef: int = 100, config: HnswConfig | None = None) -> DataFrame:
    """(q_id, id, distance, rank). The stated queries (q_id, q_vec) go to all shards as bounded broadcasts, block by
    block; each shard answers k, the merge keeps k. Null query vectors are left out."""
    config = config or HnswConfig()
    asked = queries.where("q_id is not null and q_vec is not null").select("q_id", "q_vec")
    parts = max(1, ceil(asked.count() / BLOCK))

    def answering(held):
        def answer(nodes: pd.DataFrame) -> pd.DataFrame:
            g = Layered(config)
            nodes = nodes.sort_values("id").reset_index(drop=True)
            g.ids, g.levels = nodes["id"].tolist(), nodes["level"].tolist()
            at = {i: n for n, i in enumerate(g.ids)}
            g.links = [[[at[int(j)] for j in layer] for layer in node] for node in nodes["connections"]]
            g.x = np.array(nodes["vector"].tolist(), dtype=np.float64)
            g.entry = int(np.flatnonzero(nodes["is_entry"])[0])
            out: list[tuple] = []
            for q, v in held.value:
                if len(v) != g.x.shape[1]:
                    raise DimensionMismatch(g.x.shape[1], len(v))
                out += [(q, i, d) for i, d in g.search(v, k, ef)]
            return pd.DataFrame(out, columns=["q_id", "id", "distance"]).astype({"q_id": "int64", "id": "int64", "distance": "float64"})

        return answer

    near = None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("q_id"), F.lit(parts)) == part).orderBy("q_id").collect()  # about BLOCK rows
        held = graph.sparkSession.sparkContext.broadcast([(r["q_id"], np.array(r["q_vec"], dtype=np.float64)) for r in rows])
        found = graph.groupBy("shard").applyInPandas(answering(held), "q_id long, id long, distance double")
        near = found if near is None else near.unionByName(found)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "id"))).where(f"rank <= {k}")


def beam_search(adjacency: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], queries: DataFrame, start: int | DataFrame, k: int = 10, config: GraphConfig | None = None, id: str = "node_id", vector: str = "vector") -> tuple[DataFrame, int]:
    """Searches a flat graph that stores no vectors, all queries step by step together, and fetches vectors only for
    what a step expands: ((q_id, ``id``, distance, rank), number of vectors fetched).

    A step joins each query's nearest unexpanded results to their neighbours, removes the visited by an anti-join,
    prunes, joins the vectors of what is left, and keeps ef results; it ends when no query has an unexpanded result, as
    each result is expanded once. State is written to the shared folder each step, so lineage stays short, and that of
    the step before is removed; the visited grow by a part for each step, and are merged into one now and then.
    ``start`` is a node, or a table of nodes in its first column, as of the shards of a graph: all queries begin at all of them.
    ``vectors`` may be a function that computes the vectors of the asked nodes: from a table (_n) one of (_n, _v).
    """
    config = config or GraphConfig()
    from corvex.functions import vectors as V

    ef = max(config.ef_search, k)
    asked = written(queries.where("q_vec is not null").select("q_id", "q_vec"), "asked")
    if callable(vectors):
        fetch = vectors
    else:
        have = vectors.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("_n"), F.col(vector).alias("_v"))
        fetch = lambda wanted: have.join(wanted, "_n", "left_semi")
    dist = V.distance(config.metric, F.col("q_vec"), F.col("_v"))
    spark = adjacency.sparkSession
    starts = spark.createDataFrame([(start,)], "_n long") if isinstance(start, int) else start.select(F.col(start.columns[0]).cast("long").alias("_n")).distinct()
    entries = written(fetch(starts), "entries")
    if entries.isEmpty():
        raise IndexNotBuilt(f"entry node {start if isinstance(start, int) else ''} has no vector")
    near = Window.partitionBy("q_id").orderBy("d", "_n")
    begun = written(asked.crossJoin(F.broadcast(entries)).select("q_id", "_n", dist.alias("d"), F.lit(False).alias("done")), "beam")  # one entry a shard
    visited, fetched = [written(begun.select("q_id", "_n"), "visited")], begun.count()
    state = written(begun.withColumn("_r", F.row_number().over(near)).where(f"_r <= {ef}").drop("_r"), "beam")
    freed(begun)
    links = adjacency.select(F.col("node_id").alias("_n"), "neighbors")
    while True:
        front = state.where("not done").withColumn("_r", F.row_number().over(near)).where(f"_r <= {config.beam_width}").select("q_id", "_n")
        if front.isEmpty():
            break
        filled = state.groupBy("q_id").agg(F.count("*").alias("filled"))
        reached = front.join(links, "_n").join(filled, "q_id").select("q_id", F.explode("neighbors").alias("_n"), "filled").groupBy("q_id", "_n").agg(F.max("filled").alias("filled"))
        been = visited[0]
        for v in visited[1:]:
            been = been.unionByName(v)
        fresh = written(reached.join(been, ["q_id", "_n"], "left_anti"), "fresh")
        visited.append(fresh.select("q_id", "_n"))
        lists = fresh.groupBy("q_id").agg(F.max("filled").alias("filled"), F.array_sort(F.collect_list("_n")).alias("l"))
        wanted = lists.select("q_id", F.explode(prune_list(config)).alias("_n"))
        found = written(wanted.join(fetch(wanted.select("_n").distinct()), "_n").join(asked, "q_id").select("q_id", "_n", dist.alias("d"), F.lit(False).alias("done")), "found")
        fetched += found.count()
        expanded = front.select("q_id", "_n", F.lit(True).alias("x"))
        old = state.join(expanded, ["q_id", "_n"], "left").select("q_id", "_n", "d", (F.col("done") | F.coalesce("x", F.lit(False))).alias("done"))
        new = written(old.unionByName(found).withColumn("_r", F.row_number().over(near)).where(f"_r <= {ef}").drop("_r"), "beam")
        freed(state, found)
        state = new
        if len(visited) > 16:
            merged = been.unionByName(visited[-1])
            visited = [written(merged, "visited")]
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("d", "_n"))
    out = state.withColumn("rank", rank).where(f"rank <= {k}").select("q_id", F.col("_n").alias(id), F.col("d").alias("distance"), "rank")
    return out, fetched


def prune_list(config: GraphConfig):
    from corvex.operators.graphs import prune

    return prune(F.col("l"), config, F.col("filled"))


def recompute_share(fetched: int, n_queries: int, n_nodes: int) -> float:
    """Vectors fetched for a query, as a share of all."""
    return fetched / max(1, n_queries) / max(1, n_nodes)
