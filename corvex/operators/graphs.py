"""Proximity graphs as tables: (node_id, neighbors, level) with one row a node, or edges (src, dst, dist)."""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvex.config import GraphConfig
from corvex.errors import NodeNotFound
from corvex.functions import vectors as V
from corvex.plans.knn import distances
from corvex.shared import written


def unit_hash(id: str | Column) -> Column:
    """A number in (0, 1) from the md5 of an id, the same in any engine."""
    text = F.substring(F.md5(F.col(id).cast("string") if isinstance(id, str) else id.cast("string")), 1, 8)
    return (F.conv(text, 16, 10).cast("bigint") + 1) / 4294967297.0


def level(id: str | Column, factor: float = 1 / log(30), max_layers: int = 16) -> Column:
    """The random level of a node, from its id alone."""
    return F.least(F.floor(-F.log(unit_hash(id)) * factor), F.lit(max_layers - 1)).cast("int")


def edges_of(nodes: DataFrame, id: str = "node_id", connections: str = "connections") -> DataFrame:
    """(layer, src, dst) of every layer's lists. Null lists and ids, loops and repeated edges are left out; targets that
    don't exist stay: ``existing`` removes them."""
    rows = nodes.select(F.col(id).alias("src"), F.posexplode(connections).alias("layer", "to"))
    return rows.select("layer", "src", F.explode("to").alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()


def existing(edges: DataFrame, nodes: DataFrame, id: str = "node_id") -> DataFrame:
    return edges.join(nodes.select(F.col(id).alias("dst")).distinct(), "dst", "left_semi")


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def weighted(edges: DataFrame, vectors: DataFrame, metric: str = "cosine", id: str = "node_id", vector: str = "vector") -> DataFrame:
    """Adds dist; edges with an end whose vector is missing are left out."""
    v = vectors.where(F.col(vector).isNotNull()).select(id, vector)
    joined = edges.join(v.toDF("src", "_a"), "src").join(v.toDF("dst", "_b"), "dst").where(F.size("_a") == F.size("_b"))
    return joined.select("src", "dst", V.distance(metric, F.col("_a"), F.col("_b")).alias("dist"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node_id, neighbors, degree), neighbours by distance if known, then id."""
    order = F.struct("dist", "dst") if "dist" in edges.columns else F.struct("dst")
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["dst"]).alias("neighbors"))
    return out.withColumn("degree", F.size("neighbors"))


def storage_bytes(n_nodes: int | Column, n_edges: int | Column) -> Column:
    """Of compressed rows: offsets, neighbours, levels and degrees, 8 bytes each."""
    n, e = (x if isinstance(x, Column) else F.lit(x) for x in (n_nodes, n_edges))
    return 8 * (n + 1 + e + n + n)


def closest(edges: DataFrame, most: int) -> DataFrame:
    """Of each node the ``most`` nearest of its edges (src, dst, dist), ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return edges.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def hub_preserving(edges: DataFrame, most: int, percentile: float = 0.02) -> DataFrame:
    """Caps the edges (src, dst, dist) of each node at ``most``, keeping hubs.

    Nodes within the cap keep all. The threshold is the degree of the candidate at ``percentile`` of the node's own
    candidates; hubs, by falling degree, take up to a quarter of the places, then come the nearest others, then the
    hubs that are left. A percentile of 0 or 1 makes no hubs, so the nearest stay.
    """
    degree = edges.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("_deg"))
    rows = edges.join(degree, "dst", "left").withColumn("_deg", F.coalesce("_deg", F.lit(0)))
    of, by_degree = Window.partitionBy("src"), Window.partitionBy("src").orderBy(F.desc("_deg"), "dst")
    rows = rows.withColumn("_n", F.count("*").over(of)).withColumn("_i", F.row_number().over(by_degree))
    at = F.ceil(F.col("_n") * percentile)
    some = (at > 0) & (at < F.col("_n"))  # a percentile of 0 or 1 makes no hubs
    least = F.max(F.when(some & (F.col("_i") == at), F.col("_deg"))).over(of)
    rows = rows.withColumn("_least", least).withColumn("_hub", F.coalesce(F.col("_deg") >= F.col("_least"), F.lit(False)))
    hub_rank = F.row_number().over(Window.partitionBy("src", "_hub").orderBy(F.desc("_deg"), "dst"))
    slots = max(most // 4, 1)
    rows = rows.withColumn("_class", F.when(F.col("_hub") & (hub_rank <= slots), 0).when(~F.col("_hub"), 1).otherwise(2))
    place = F.row_number().over(Window.partitionBy("src").orderBy("_class", F.when(F.col("_class") == 1, F.col("dist")).otherwise(-F.col("_deg")), "dst"))
    return rows.withColumn("_p", place).where((F.col("_n") <= most) | (F.col("_p") <= most)).select("src", "dst", "dist")


def global_hubs(edges: DataFrame, percentile: float = 0.02) -> DataFrame:
    """(node_id, degree) of the nodes within the top ``percentile`` by degree, by one approximate quantile (error under
    a ten-thousandth), not by a global sort."""
    d = degrees(edges)
    cut = d.agg(F.expr(f"percentile_approx(degree, {1 - percentile}, 10000)").alias("cut"))
    return d.join(F.broadcast(cut), F.col("degree") >= F.col("cut")).select("node_id", "degree")  # one row


def by_degree(edges: DataFrame, hubs: DataFrame, hub_cap: int, cap: int) -> DataFrame:
    """Hubs keep ``hub_cap`` nearest edges, others ``cap``."""
    rows = edges.join(hubs.select(F.col("node_id").alias("src"), F.lit(True).alias("_hub")), "src", "left")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= F.when(F.col("_hub"), hub_cap).otherwise(cap)).select("src", "dst", "dist")


def prune(neighbors: Column, config: GraphConfig, filled: Column | int = 0, salt: Column | None = None, degree: Column | None = None) -> Column:
    """The neighbours that a search step still computes.

    global: the more results it has (``filled`` of ef), the fewer; local: a fixed share; proportional: each neighbour
    with a probability by its degree, decided by a hash, and the first alone if that leaves none. Ratio 0 and empty
    lists pass unchanged.
    """
    if config.prune_ratio == 0:
        return neighbors
    n = F.size(neighbors)
    if config.pruning == "global":
        full = (filled if isinstance(filled, Column) else F.lit(filled)) / config.ef_search
        keep = F.ceil(n * (1 - full * config.prune_ratio))
    else:
        keep = F.ceil(n * (1 - config.prune_ratio))
    keep = F.greatest(F.lit(1), keep.cast("int"))
    if config.pruning == "proportional" and degree is not None:
        total = F.aggregate(degree, F.lit(0.0), lambda s, d: s + d.cast("double"))
        pairs = F.arrays_zip(neighbors.alias("id"), degree.alias("deg"))
        kept = F.filter(pairs, lambda p: unit_hash(F.concat_ws("/", salt.cast("string") if salt is not None else F.lit(""), p["id"].cast("string"))) < p["deg"] / total * keep)
        chosen = F.slice(F.transform(kept, lambda p: p["id"]), F.lit(1), keep)
        first = F.slice(neighbors, F.lit(1), F.lit(1))
        return F.when(total == 0, F.slice(neighbors, F.lit(1), keep)).when(F.size(chosen) == 0, first).otherwise(chosen)
    return F.when(n == 0, neighbors).otherwise(F.slice(neighbors, F.lit(1), keep))


def entry_point(nodes: DataFrame, id: str = "node_id", level: str = "level") -> DataFrame:
    """One row: the first node of the highest level."""
    return nodes.where(F.col(level).isNotNull()).agg(F.min_by(F.struct(id, level), F.struct(-F.col(level), F.col(id))).alias("e")).select(f"e.{id}", f"e.{level}").where(F.col(id).isNotNull())


def reachable(edges: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """(node_id, hop): nodes within ``hops`` of the start nodes (None: as far as the edges go), with the fewest hops.

    The visited are anti-joined; each hop's front is written to the shared folder, so a plan holds one hop.
    """
    seen = written(start.select("node_id").where("node_id is not null").distinct().withColumn("hop", F.lit(0)), "hop")
    front, h = seen, 0
    while hops is None or h < hops:
        h += 1
        step = edges.join(front.select(F.col("node_id").alias("src")), "src").select(F.col("dst").alias("node_id")).distinct()
        front = written(step.join(seen.select("node_id"), "node_id", "left_anti").withColumn("hop", F.lit(h)), "hop")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # tables, not plans of hops
    return seen


def degree_cap(n: int, percentile: float) -> int:
    return max(1, ceil(n * percentile))


def offsets(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Adds ``offset``, where a node's neighbours begin in the flat list of all, by node_id.

    Running sums in three levels: within blocks of ids, within blocks of blocks, and over the sums of those, of which
    there is one for each ``block`` squared ids (16 million), so no window goes over the whole graph.
    """
    rows = rows.withColumn("_b", F.floor(F.col("node_id") / block)).withColumn("_c", F.floor(F.col("node_id") / (block * block)))
    sums = rows.groupBy("_c", "_b").agg(F.sum("degree").alias("_s"))
    tops = sums.groupBy("_c").agg(F.sum("_s").alias("_t"))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_c", F.coalesce(F.sum("_t").over(until(Window.orderBy("_c"))), F.lit(0)).alias("_top"))
    mids = sums.select("_c", "_b", F.coalesce(F.sum("_s").over(until(Window.partitionBy("_c").orderBy("_b"))), F.lit(0)).alias("_mid"))
    inner = F.coalesce(F.sum("degree").over(until(Window.partitionBy("_b").orderBy("node_id"))), F.lit(0))
    joined = rows.withColumn("_in", inner).join(mids, ["_c", "_b"]).join(tops, "_c")
    return joined.withColumn("offset", (F.col("_top") + F.col("_mid") + F.col("_in")).cast("long")).drop("_b", "_c", "_top", "_mid", "_in")


def neighbors_of(rows: DataFrame, id: int) -> list[int] | None:
    """The neighbours of a node, None if there is no such node."""
    row = rows.where(F.col("node_id") == id).select("neighbors").first()
    return None if row is None else list(row[0])


def vectors_of(vectors: DataFrame, ids: DataFrame, id: str = "node_id", vector: str = "vector") -> DataFrame:
    """(``id``, ``vector``) of the asked nodes; one without a vector is an error, found before anything is computed."""
    asked = ids.select(id).distinct()
    have = vectors.where(F.col(vector).isNotNull()).select(id, vector)
    missing = asked.join(have, id, "left_anti").first()
    if missing is not None:
        raise NodeNotFound(missing[0])
    return have.join(asked, id, "left_semi")


def select_diverse(edges: DataFrame, vectors: DataFrame, most: int, metric: str = "cosine", id: str = "node_id", vector: str = "vector") -> DataFrame:
    """Of each node's candidates (src, dst, dist), nearest first, those nearer to the node than to any one chosen before,
    up to ``most``: links in different directions. A node's candidates are a bounded list, its group a bounded task."""
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(id).alias("dst"), F.col(vector).alias("_v"))
    rows = closest(edges, 8 * most).join(v, "dst")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dist", "dst"])
        x = np.array(pdf["_v"].tolist(), dtype=np.float64)
        between, kept = distances(metric, x, x), []
        for i, d in enumerate(pdf["dist"]):
            if len(kept) < most and all(d < between[i, j] for j in kept):
                kept.append(i)
        return pdf.iloc[kept][["src", "dst", "dist"]]

    return rows.groupBy("src").applyInPandas(choose, "src long, dst long, dist double")


def with_neighbors(rows: DataFrame, id: int, neighbors: list[int]) -> DataFrame:
    """The graph with one node's list replaced; an unknown node changes nothing."""
    new = F.array(*(F.lit(int(n)) for n in neighbors)).cast("array<bigint>")
    hit = F.col("node_id") == id
    return rows.withColumn("neighbors", F.when(hit, new).otherwise(F.col("neighbors"))).withColumn("degree", F.when(hit, len(neighbors)).otherwise(F.col("degree")))


def with_node(rows: DataFrame, id: int, neighbors: list[int]) -> DataFrame:
    """The graph with one more node, in place of one of the same id."""
    new = rows.sparkSession.createDataFrame([(id, neighbors, len(neighbors))], "node_id long, neighbors array<bigint>, degree int")
    return rows.where(F.col("node_id") != id).select("node_id", "neighbors", "degree").unionByName(new)
