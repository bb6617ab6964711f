"""Exact nearest-neighbour search: one query as a plan that ends in a partial top-k per task, stated query sets in blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvex.config import SearchConfig
from corvex.errors import DimensionMismatch, InvalidConfig, WorkspaceNotFound
from corvex.functions import vectors as V

BLOCK = 4096  # queries that one task compares with its vectors


def search(vectors: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", id: str = "vec_id", vector: str = "embedding", min_similarity: float | None = None) -> DataFrame:
    """(``id``, distance): the k nearest, ties to the smaller id. ``min_similarity`` filters after the k are taken.

    Null vectors take no part; a wrong dimension fails the query; an empty table or k = 0 gives no rows. For the
    Euclidean metric the square orders the rows, the root is taken of the k alone.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id), F.col(vector).alias("_v"))
    q = V.literal(query)
    order = V.squared_distance("euclidean", F.col("_v"), q) if metric == "euclidean" else V.distance(metric, F.col("_v"), q)
    wrong = F.size("_v") != len(query)
    order = F.when(wrong, F.raise_error(F.lit(f"expected dimension {len(query)}")).cast("double")).otherwise(order)
    top = rows.select(id, order.alias("_d")).orderBy("_d", id).limit(k)
    top = top.select(id, (F.sqrt("_d") if metric == "euclidean" else F.col("_d")).alias("distance"))
    return top if min_similarity is None else top.where(V.similarity(F.col("distance")) >= min_similarity)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as a matrix of double; lengths must be equal."""
    n = len(column)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if n and len(flat) % n:
        raise DimensionMismatch(len(flat) // n, -1)
    return flat.reshape(n, -1)


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All distances between rows of q and rows of x."""
    if q.shape[1] != x.shape[1]:
        raise DimensionMismatch(q.shape[1], x.shape[1])
    if metric == "manhattan":
        return np.abs(q[:, None, :] - x[None, :, :]).sum(axis=2)
    dots = q @ x.T
    if metric == "dot":
        return -dots
    nq, nx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    if metric == "euclidean":
        return np.sqrt(np.maximum(nq[:, None] + nx[None, :] - 2 * dots, 0))
    n = np.sqrt(nq[:, None] * nx[None, :])
    return np.where(n == 0, 1.0, 1 - dots / np.where(n == 0, 1, n))


def _best(metric: str, q: np.ndarray, x: np.ndarray, k: int, digits: int | None = None, ties: int | None = None) -> tuple[np.ndarray, ...]:
    """(row of q, row of x, order, distance) of the k nearest rows of x to each row of q; ties to the smaller row of x."""
    out, step = [], max(1, 2_000_000 // max(1, len(x) * (x.shape[1] if metric == "manhattan" else 1)))
    for i in range(0, len(q), step):
        d = distances(metric, q[i : i + step], x)
        d = d if digits is None else np.round(d, digits)
        order = d if ties is None else np.round(d, ties) + 0.0  # no -0.0
        for j, row in enumerate(order):
            best = np.argsort(row, kind="stable")[:k] if len(row) <= 4 * k else _few(row, k)
            out.append((np.full(len(best), i + j), best, row[best], d[j][best]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def _few(row: np.ndarray, k: int) -> np.ndarray:
    edge = np.partition(row, k - 1)[k - 1]
    near = np.flatnonzero(~(row > edge))  # with all that tie with the last
    return near[np.argsort(row[near], kind="stable")][:k]


def search_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id: str = "vec_id", vector: str = "embedding", tag: str | None = None, digits: int | None = None, ties: int | None = None) -> DataFrame:
    """(q_id, ``tag`` if any, ``id``, distance, rank): for each stated query the k nearest vectors, each with its tag.

    Queries and vectors meet block by block, in numpy: a task holds at most BLOCK queries and streams its vectors past
    them, keeping k for each. Up to BLOCK queries go to all executors as one bounded broadcast and the vectors aren't
    shuffled; more are shuffled against blocks of vectors. ``queries`` has q_id and q_vec. Ties go to the smaller id,
    then to the smaller tag; with ``digits`` distances are rounded first, with ``ties`` those that are equal when
    rounded tie, and are given unrounded. Null vectors take no part.
    """
    carried = [F.col(tag).alias("_g")] if tag else []
    vectors = vectors.where(F.col(vector).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("_id"), F.col(vector).alias("_v"), *carried)
    queries = queries.where("q_id is not null and q_vec is not null").select(F.col("q_id").cast("long").alias("q_id"), "q_vec")
    n = queries.count()
    fields = "q_id long, _id long, _o double, distance double" + (f", _g {vectors.schema['_g'].dataType.simpleString()}" if tag else "")
    names = ["q_id", "_id", "_o", "distance", *(["_g"] if tag else [])]

    def nearest(qid: np.ndarray, q: np.ndarray, block: pa.Table) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in ("_id", "_g") if c in block.column_names]).combine_chunks()
        found = _best(metric, q, matrix(block["_v"].combine_chunks()), k, digits, ties) if len(q) and block.num_rows else _best(metric, np.zeros((0, 0)), np.zeros((0, 0)), k)
        me, them = found[:2]
        taken = [block[c].take(pa.array(them)) for c in ("_id", "_g") if c in block.column_names]
        return pa.table([pa.array(qid[me], pa.int64()), taken[0], *map(pa.array, found[2:]), *taken[1:]], names=names)

    if n <= BLOCK:
        rows = queries.orderBy("q_id").toArrow().combine_chunks()  # at most BLOCK rows
        held = vectors.sparkSession.sparkContext.broadcast((rows["q_id"].to_numpy(), matrix(rows["q_vec"].combine_chunks()) if n else np.zeros((0, 0))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from nearest(*held.value, pa.Table.from_batches([batch])).to_batches()

        near = vectors.mapInArrow(scan, fields)
    else:
        qb, vb = ceil(n / BLOCK), max(1, ceil(vectors.count() / (4 * BLOCK)))
        each = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        spread = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        left = queries.select("q_id", "q_vec", each("q_id", qb).alias("qb"), spread(vb).alias("vb"))
        right = vectors.select("*", each("_id", vb).alias("vb"), spread(qb).alias("qb"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            return nearest(a["q_id"].to_numpy(), matrix(a["q_vec"].combine_chunks()) if a.num_rows else np.zeros((0, 0)), b)

        near = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(meet, fields)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("_o", "_id", *([F.asc_nulls_last("_g")] if tag else [])))
    top = near.withColumn("rank", rank).where(f"rank <= {k}")
    return top.select("q_id", *([F.col("_g").alias(tag)] if tag else []), F.col("_id").alias(id), "distance", "rank")


def search_with(vectors: DataFrame, query: Sequence[float], settings: SearchConfig, metric: str = "cosine", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``search`` by settings: top_k, min_similarity (for metrics without negative distances), and the vectors too if
    they are asked for."""
    if settings.min_similarity is not None and metric == "dot":
        raise InvalidConfig("min_similarity needs a metric without negative distances")
    top = search(vectors, query, settings.top_k, metric, id, vector, settings.min_similarity)
    if not settings.include_vectors:
        return top
    return vectors.select(id, F.col(vector).alias("vector")).join(F.broadcast(top), id)  # at most top_k rows


def multi_index(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", index: str = "index_name", **options) -> DataFrame:
    """k of each index, tagged with its name, merged to the k nearest of all: (q_id, index, id, distance, rank).

    The k nearest of all are among the k of their indexes, so they are the k nearest of all vectors in the same order:
    no k for each pair of query and index need be held."""
    return search_batch(vectors, queries, k, metric, tag=index, **options)


def in_indexes(vectors: DataFrame, names: Sequence[str], index: str = "index_name") -> DataFrame:
    """Only the named indexes; unknown names are ignored. With vectors partitioned by index, a partition filter."""
    return vectors.where(F.col(index).isin(*names)) if names else vectors.where(F.lit(False))


def in_workspace(vectors: DataFrame, workspaces: DataFrame, name: str, index: str = "index_name") -> DataFrame:
    """The indexes of a workspace's repositories, by a semi-join; a missing workspace is an error."""
    if workspaces.where(F.col("name") == name).isEmpty():
        raise WorkspaceNotFound(name)
    wanted = workspaces.where(F.col("name") == name).select(F.explode("repositories").alias("r")).select(F.concat_ws("/", "r.provider", "r.full_name").alias(index)).distinct()
    return vectors.join(wanted, index, "left_semi")


def hits(results: DataFrame, files: DataFrame, index: str = "index_name", id: str = "vec_id", snippet: int = 200) -> DataFrame:
    """(q_id, score, index, path, snippet): results joined to their files, of which no more than the snippet is moved."""
    more = [index] if index not in results.columns else []
    rows = results.join(files.select(F.col("file_id").alias(id), "path", F.left("content", F.lit(snippet)).alias("snippet"), *more), id)
    return rows.select("q_id", V.service_score(F.col("distance")).alias("score"), F.col(index).alias("index"), "path", "snippet")


def recall(found: DataFrame, truth: DataFrame, id: str = "vec_id") -> DataFrame:
    """One row: the share of true neighbours that were found."""
    keys = ["q_id", id]
    hit = truth.select(*keys).join(found.select(*keys).distinct().withColumn("hit", F.lit(1.0)), keys, "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def query_set(vectors: DataFrame, every: int = 50, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The stated queries of the reports: rows whose id is divisible by ``every``."""
    return vectors.where((F.col(id) % every == 0) & F.col(vector).isNotNull()).select(F.col(id).alias("q_id"), F.col(vector).alias("q_vec"))


def vector_of(vectors: DataFrame, key: int, id: str = "vec_id", vector: str = "embedding") -> list[float]:
    row = vectors.where(F.col(id) == key).select(vector).first()
    return [] if row is None or row[0] is None else list(row[0])


def context(hit_rows: DataFrame, most: int = 5, chars: int = 1000) -> DataFrame:
    """(q_id, context): the best hits of each query as one text for a prompt, each with its place and a cut of its snippet.
    A hit without index or path comes after those of its score that have one."""
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), F.asc_nulls_last("index"), F.asc_nulls_last("path"), "snippet"))
    line = F.concat(F.lit("["), F.coalesce("index", F.lit("")), F.lit("] "), F.coalesce("path", F.lit("")), F.lit("\n"), F.coalesce(F.left("snippet", F.lit(chars)), F.lit("")))
    rows = hit_rows.withColumn("_r", rank).where(F.col("_r") <= most).groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("t")))).alias("l"))
    return rows.select("q_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("context"))
