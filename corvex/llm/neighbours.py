"""The most similar vectors for every vector: multiprobe p-stable hashing, exact distances for what it finds.

Vectors are scaled to length 1, so cosine distance is half the squared distance. Each of ``tables`` tables has a home
bucket for a vector, and the vector also visits the buckets next to it in the order of their estimated success.
Candidates of all tables are merged, thinned by a 128-bit sign sketch (only those far outside the radius go), and
ranked by exact distance. Equal vectors are one class and are compared once, however many there are.

Buckets with more than ``hot`` vectors are compared in blocks as matrices: of all their pairs, those that are among the
k nearest of either vector in a block go on, so none that counts is lost. Vectors with fewer than k neighbours within the
radius, for which hashing cannot promise a result, are the stated queries of an exact search in blocks over all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvex.llm.probes import Hashing
from corvex.llm.rolling import Rolling
from corvex.shared import written

BLOCK = 8192
_BITS = 128


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # lengths of very large or small vectors stay finite
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, same, v): the usable vectors as bytes of float, and a hash by which equal ones are recognised."""
    data = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<float>").alias("v")).where(f"id is not null and size(v) = {dim}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = lists.flatten()
            null = np.asarray(x.is_null()).reshape(-1, dim).any(axis=1)
            x = np.ascontiguousarray(x.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)) + np.float32(0)  # -0 becomes 0
            good = ~null & np.isfinite(x).all(axis=1) & x.any(axis=1)
            x = x[good]
            raw = np.ascontiguousarray(x).view(np.uint32).ravel()
            same = Rolling(raw).at(np.arange(len(x)) * dim, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(same.view(np.int64)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "same", "v"])

    return data.mapInArrow(run, "id long, same long, v binary")


def _entries(reps: DataFrame, dim: int, hashing: tuple) -> DataFrame:
    """(bucket, home, id, s1, s2): the bucket a vector lives in, for each table, and those it visits."""
    m, width, tables, probes = hashing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing(dim, m, width, tables, probes)
        planes = np.random.default_rng(11).standard_normal((dim, _BITS))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = _unit(_matrix(part.column(1), dim))
                home, visit = hashing.keys(x)
                sketch = np.packbits(x @ planes > 0, axis=1).view(np.int64)
                keys = np.concatenate([home[:, :, None], visit], axis=2)
                each = keys.shape[1] * keys.shape[2]
                is_home = np.zeros(keys.shape[1:], bool)
                is_home[:, 0] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel().view(np.int64)),
                        pa.array(np.tile(is_home.ravel(), len(x))),
                        pa.array(np.repeat(part.column(0).to_numpy(), each)),
                        pa.array(np.repeat(sketch[:, 0], each)),
                        pa.array(np.repeat(sketch[:, 1], each)),
                    ],
                    names=["bucket", "home", "id", "s1", "s2"],
                )

    return reps.select("id", "v").mapInArrow(run, "bucket long, home boolean, id long, s1 long, s2 long")


def _candidates(reps: DataFrame, dim: int, k: int, radius: float, hashing: tuple, hot: int) -> DataFrame:
    angle = acos(1 - min(radius, 1.0)) / pi
    most = ceil(_BITS * angle + 3.7 * sqrt(_BITS * angle * (1 - angle)))
    entries = _entries(reps, dim, hashing)
    crowded = written(entries.where("home").groupBy("bucket").count().where(F.col("count") > hot).select("bucket"), "crowded")
    some = not crowded.isEmpty()
    calm = entries.join(crowded, "bucket", "left_anti") if some else entries
    a, b = calm.where("home").toDF("bucket", "h1", "a", "a1", "a2"), calm.toDF("bucket", "h2", "b", "b1", "b2")
    near = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2"))) <= most
    pairs = a.join(b, "bucket").where(F.col("a") != F.col("b")).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if some:
        pairs = pairs.unionByName(_crowded_pairs(reps, entries.join(crowded, "bucket", "left_semi").select("bucket", "home", "id"), dim, k, radius))
    return pairs.distinct()


def _best(qids: np.ndarray, qs: np.ndarray, ids: np.ndarray, xs: np.ndarray, k: int, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(q, c): the k nearest within the radius of each query, ties to the smaller id; a few more may come along."""
    order = np.argsort(ids)
    ids, xs, take = ids[order], xs[order], min(k + 2, len(ids))
    for i in range(0, len(qs), 512):
        d = 1 - qs[i : i + 512] @ xs.T
        far = (d > radius + 1e-9) | (qids[i : i + 512, None] == ids[None, :])
        # Distance to 2^-40, then place by id.
        rank = (np.rint(d * (1 << 40)).astype(np.int64) << 20) + np.arange(len(ids))
        rank[far] = np.iinfo(np.int64).max
        best = np.argpartition(rank, take - 1, axis=1)[:, :take]
        keep = ~np.take_along_axis(far, best, axis=1)
        yield np.repeat(qids[i : i + 512], take)[keep.ravel()], ids[best[keep]]


def _crowded_pairs(reps: DataFrame, entries: DataFrame, dim: int, k: int, radius: float) -> DataFrame:
    """(a, b), a < b: of all pairs of a vector at home in a bucket with one in it, those among the k nearest of either in
    a block. k nearer ones in the same block are candidates too, so no other pair can be in a list."""
    entries = written(entries, "crowds")
    sizes = entries.groupBy("bucket").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("nh"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nv"))
    placed = entries.join(sizes, "bucket").select("bucket", "home", "id", "nh", "nv", F.expr("cast(pmod(xxhash64(id), nh) as int)").alias("h"), F.expr("cast(pmod(xxhash64(id), nv) as int)").alias("v"))
    vectors = lambda: reps.select(F.col("id").alias("id"), F.col("v").alias("x"))
    one = placed.where("home").select("bucket", "h", F.explode(F.expr("sequence(0, nv - 1)")).alias("v"), "id").join(vectors(), "id").select("bucket", "h", "v", "id", "x")
    other = placed.select("bucket", F.explode(F.expr("sequence(0, nh - 1)")).alias("h"), "v", "home", "id").join(vectors(), "id")
    # New aliases: both sides come from one table.
    other = other.select(*(F.col(c).alias(c) for c in ("bucket", "h", "v", "home", "id", "x")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            aids, a = left.column("id").to_numpy(), _unit(_matrix(left.column("x"), dim))
            bids, b = right.column("id").to_numpy(), _unit(_matrix(right.column("x"), dim))
            guest = ~right.column("home").to_numpy()  # the lists of those at home come from the first direction
            out += [*_best(aids, a, bids, b, k, radius), *_best(bids[guest], b[guest], aids, a, k, radius)]
        q, c = (np.concatenate([o[j] for o in out]) for j in (0, 1))
        return pa.table({"a": np.minimum(q, c), "b": np.maximum(q, c)})

    return one.groupBy("bucket", "h", "v").cogroup(other.groupBy("bucket", "h", "v")).applyInArrow(run, "a long, b long")


def _near(reps: DataFrame, pairs: DataFrame, dim: int, radius: float) -> DataFrame:
    """(a, b, d) of the pairs within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = 1 - (_unit(_matrix(batch.column(2), dim)) * _unit(_matrix(batch.column(3), dim))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["a", "b", "d"]).filter(pa.array(d <= radius))

    v = reps.select("id", "v")
    joined = pairs.join(v.toDF("a", "va"), "a").join(v.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
    return joined.mapInArrow(run, "a long, b long, d double")


def _blocks(reps: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """(q, c, d): the k nearest classes of each asked class, exactly, block of queries by block of vectors."""
    n, n_asked = reps.count(), asked.count()
    db, qb = max(1, ceil(n / BLOCK)), max(1, ceil(n_asked / BLOCK))
    at = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    q = reps.join(asked, "id", "left_semi").select("id", "v", at(qb).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(db - 1))).alias("d"))
    # New aliases: both sides come from one table.
    x = reps.select(F.col("id").alias("id"), F.col("v").alias("v"), at(db).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        ids, xs = right.column("id").to_numpy(), _unit(_matrix(right.column("v"), dim))
        qids, qs = left.column("id").to_numpy(), _unit(_matrix(left.column("v"), dim))
        out, take = [], min(k + 1, len(ids))
        for i in range(0, len(qs), 512):
            d = 1 - qs[i : i + 512] @ xs.T
            d[qids[i : i + 512, None] == ids[None, :]] = np.inf
            best = np.argpartition(d, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(d), 1))
            exact = 1 - (qs[i : i + 512, None, :] * xs[best]).sum(axis=2)
            keep = np.isfinite(np.take_along_axis(d, best, axis=1))
            out.append((np.repeat(qids[i : i + 512], best.shape[1])[keep.ravel()], ids[best][keep], exact[keep]))
        return pa.table({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("q", "c", "d"))})

    pairs = q.groupBy("q", "d").cogroup(x.groupBy("q", "d")).applyInArrow(run, "q long, c long, d double")
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))).where(f"r <= {k}").drop("r")


def nearest(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = 10,
    dim: int = 64,
    radius: float = 0.15,
    functions: int = 12,
    width: float = 1.6,
    tables: int = 10,
    probes: int = 10,
    hot: int = 1000,
    rest: bool = True,
) -> DataFrame:
    """(``key``, neighbour, rank, distance): the k nearest others of each vector by cosine distance, ties to the smaller
    key.

    Null, empty, wrong-dimension, NaN, infinite and all-zero vectors and vectors with a null element take no part; a
    repeated key counts once (the smallest of its vectors by hash). With ``rest=False`` only neighbours within
    ``radius`` come out. An empty table gives an empty result; fewer than k + 1 vectors give shorter lists.
    """
    vectors = written(_vectors(df, key, vector, dim), "vectors")
    one = Window.partitionBy("id").orderBy("same")
    vectors = vectors.withColumn("_i", F.row_number().over(one)).where("_i = 1").drop("_i")
    nodes = written(vectors.select("id", "same"), "nodes")
    first = nodes.withColumn("r", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where(f"r <= {k + 1}")
    classes = written(first.groupBy("same").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    reps = written(vectors.join(classes, vectors["id"] == classes["rep"], "left_semi").select("id", "v"), "reps")
    near = written(_near(reps, _candidates(reps, dim, k, radius, (functions, width, tables, probes), hot), dim, radius), "near")

    both = near.select(F.col("a").alias("q"), F.col("b").alias("c"), "d").unionByName(near.select(F.col("b").alias("q"), F.col("a").alias("c"), "d"))
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "c"))).where(f"r <= {k}").drop("r")
    ids = classes.select(F.col("rep").alias("c"), "ids")
    if rest:
        # What is found counts with all members of a class, but not the class's own first one.
        known = top.join(ids, "c").groupBy("q").agg(F.sum(F.size("ids")).alias("m"))
        own = classes.select(F.col("rep").alias("q"), (F.size("ids") - 1).alias("own"))
        few = own.join(known, "q", "left").where(F.col("own") + F.coalesce("m", F.lit(0)) < k).select(F.col("q").alias("id"))
        few = written(few, "few")
        if not few.isEmpty():
            exact = _blocks(reps, few, dim, k)
            top = top.join(few, top["q"] == few["id"], "left_anti").unionByName(exact)
    own = classes.select(F.col("rep").alias("q"), F.col("rep").alias("c"), F.lit(0.0).alias("d"))
    lists = (
        top.unionByName(own)
        .join(ids, "c")
        .select("q", F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))).alias("l"))
        .groupBy("q")
        .agg(F.slice(F.sort_array(F.flatten(F.collect_list("l"))), 1, k + 1).alias("l"))
    )
    each = nodes.join(classes.select("same", F.col("rep").alias("q")), "same").join(lists, "q")
    out = each.select("id", F.posexplode(F.slice(F.filter("l", lambda x: x["id"] != F.col("id")), 1, k)).alias("r", "x"))
    return out.select(F.col("id").alias(key), F.col("x.id").alias("neighbour"), (F.col("r") + 1).alias("rank"), F.col("x.d").alias("distance"))


def near_pairs(df: DataFrame, key: str, vector: str, k: int = 10, radius: float = 0.15, **options) -> DataFrame:
    """(a, b), a < b: pairs at most ``radius`` apart of which at least one is among the other's k nearest."""
    found = nearest(df, key, vector, k=k, radius=radius, rest=False, **options)
    return found.where(F.col("distance") <= radius).select(F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b")).distinct()
