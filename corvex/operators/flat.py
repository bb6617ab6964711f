"""Flat graphs that keep no vectors: built node by node in each shard, or from each shard's exact neighbours.

A shard has a bounded number of vectors, so no task's group grows with the corpus. Its graph is a set of rows
(node_id, neighbors, degree, level, is_entry); searches fetch vectors only for the nodes they expand.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvex.config import GraphConfig
from corvex.errors import DimensionMismatch
from corvex.operators import graphs
from corvex.operators.hnsw import seeded_level, with_shards
from corvex.plans.knn import distances

SCHEMA = "shard string, node_id long, neighbors array<long>, degree int, level int, is_entry boolean"


def keep_hubs(degree: np.ndarray, most: int, percentile: float) -> np.ndarray:
    """Which of the candidates, nearest first, a node keeps: as ``graphs.hub_preserving``, for one node."""
    n = len(degree)
    if n <= most:
        return np.arange(n)
    at = int(np.ceil(n * percentile))
    hub = degree >= np.sort(degree)[::-1][at - 1] if 0 < at < n else np.zeros(n, bool)
    hubs, others = np.flatnonzero(hub), np.flatnonzero(~hub)
    hubs = hubs[np.argsort(-degree[hubs], kind="stable")]
    slots = max(most // 4, 1)
    return np.concatenate([hubs[:slots], others, hubs[slots:]])[:most]


class Flat:
    """The graph of one shard while it is built, with its vectors."""

    def __init__(self, config: GraphConfig, x: np.ndarray):
        self.config, self.x = config, x
        self.links: list[list[int]] = []
        self.entry, self.top = 0, -1

    def near(self, q: np.ndarray, ef: int) -> list[int]:
        """The ef nearest nodes that a best-first search from the entry finds, nearest first."""
        d = float(distances(self.config.metric, q[None], self.x[[self.entry]])[0, 0])
        seen, todo, best = {self.entry}, [(d, self.entry)], [(-d, -self.entry)]
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in self.links[i] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(distances(self.config.metric, q[None], self.x[new])[0].tolist(), new):
                if len(best) < ef or e < -best[0][0]:
                    heapq.heappush(todo, (e, j))
                    heapq.heappush(best, (-e, -j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return [i for _, i in sorted((-d, -i) for d, i in best)]

    def add(self, level: int) -> None:
        """Links the next node to what it finds, both ways; a list that is too long keeps its nearest."""
        n, c = len(self.links), self.config
        found = self.near(self.x[n], c.ef_construction) if n else []
        if c.keep_hubs:
            found = [found[i] for i in keep_hubs(np.array([len(self.links[j]) for j in found], np.int64), c.m0, c.hub_percentile)]
        self.links.append(found[: c.m0])
        for i in self.links[n]:
            self.links[i].append(n)
            if len(self.links[i]) > c.m0:
                d = distances(c.metric, self.x[[i]], self.x[self.links[i]])[0]
                self.links[i] = [self.links[i][j] for j in np.lexsort((self.links[i], d))[: c.m0]]
        if level > self.top:
            self.entry, self.top = n, level


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    sizes = {len(v) for v in pdf["_v"]}
    if len(sizes) > 1:
        raise DimensionMismatch(*sorted(sizes)[:2])
    return np.array(pdf["_v"].tolist(), dtype=np.float64)


def build(vectors: DataFrame, config: GraphConfig | None = None, id: str = "vec_id", vector: str = "embedding", index: str | None = None) -> DataFrame:
    """(shard, node_id, neighbors, degree, level, is_entry): a graph for each shard, nodes inserted by id.

    Neighbours come nearest first, at most m0 of them. Levels come from ids, so a build repeats exactly. Null vectors and
    ids take no part, a repeated id counts once; vectors of different dimension within a shard fail the build; an empty
    table gives an empty graph.
    """
    config = config or GraphConfig()

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id").drop_duplicates("_id")
        g, ids = Flat(config, _matrix(pdf)), pdf["_id"].to_numpy()
        levels = [seeded_level(int(i), config.level_factor, config.max_layers) for i in ids]
        for level in levels:
            g.add(level)
        links = []
        for i, to in enumerate(g.links):
            d = distances(config.metric, g.x[[i]], g.x[to])[0] if to else np.zeros(0)
            links.append(ids[np.array(to, int)[np.lexsort((ids[to], d))]] if to else np.zeros(0, np.int64))
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "node_id": ids, "neighbors": links, "degree": [len(x) for x in links], "level": levels, "is_entry": [i == g.entry for i in range(len(ids))]})

    return with_shards(vectors, id, vector, index).groupBy("shard").applyInPandas(shard, SCHEMA)


def nearest_edges(vectors: DataFrame, config: GraphConfig | None = None, id: str = "vec_id", vector: str = "embedding", index: str | None = None) -> DataFrame:
    """(src, dst, dist): each vector's m nearest others of its shard, exactly, ties to the smaller id."""
    config = config or GraphConfig()

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id").drop_duplicates("_id")
        x, ids = _matrix(pdf), pdf["_id"].to_numpy()
        out = []
        for i in range(0, len(x), 512):
            d = distances(config.metric, x[i : i + 512], x)
            for r, row in enumerate(d):
                order = np.lexsort((ids, np.round(row, 9)))
                order = order[order != i + r][: config.m]
                out.append((np.full(len(order), ids[i + r]), ids[order], row[order]))
        return pd.DataFrame({c: np.concatenate([o[j] for o in out]) for j, c in enumerate(("src", "dst", "dist"))})

    return with_shards(vectors, id, vector, index).groupBy("shard").applyInPandas(shard, "src long, dst long, dist double")


def build_exact(vectors: DataFrame, config: GraphConfig | None = None, **columns) -> DataFrame:
    """(node_id, neighbors, degree): each shard's exact neighbours, both ways, capped at m0 with hubs kept."""
    config = config or GraphConfig()
    edges = nearest_edges(vectors, config, **columns)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    capped = graphs.hub_preserving(both, config.m0, config.hub_percentile) if config.keep_hubs else graphs.closest(both, config.m0)
    return graphs.adjacency(capped)


def entries(graph: DataFrame) -> DataFrame:
    """The node of each shard where searches begin."""
    return graph.where("is_entry").select("node_id")


def estimated_bytes(n: int, dimension: int = 384) -> int:
    """Of n vectors of float as stored before a graph replaces them."""
    return 4 * n * dimension


def placeholder(rows: DataFrame, id: str = "file_id", dimension: int = 384) -> DataFrame:
    """(``id``, embedding): all-zero vectors, where there is no embedder."""
    return rows.select(id, F.array_repeat(F.lit(0.0).cast("float"), dimension).alias("embedding"))


def level_counts(graph: DataFrame) -> DataFrame:
    """(level, n_nodes, n_links): how a graph is made up; its length is the sum of n_nodes."""
    return graph.groupBy("level").agg(F.count("*").alias("n_nodes"), F.sum("degree").alias("n_links"))


def ranked(found: DataFrame, k: int, id: str = "node_id") -> DataFrame:
    """Results of several graphs as one list for each query."""
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("distance", id))
    return found.withColumn("rank", rank).where(f"rank <= {k}")
