"""Connected components by alternating stars: no node's neighbours are gathered, only their minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.shared import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, root): for each node of the edges (u, v) the smallest node of its component.

    A round links every larger neighbour of a node to the smallest of them (large star), then every node and its
    smaller neighbours to the smallest of those (small star), until nothing changes; the number of rounds grows with
    the logarithm of the longest path. Loops, repeated edges and an empty table are fine.
    """
    edges = written(edges.where("u <> v").distinct(), "edges")
    before = None
    while True:
        around = _both(edges)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("u"), F.col("v").alias("root"))
    return edges.select("u", F.col("v").alias("root")).unionByName(roots).distinct()
