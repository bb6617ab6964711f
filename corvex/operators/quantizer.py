"""Product quantization: subvectors, codebooks, codes, asymmetric distances and two-level search, as DataFrames.

A codebook is a table (sq, code, centroid) of subquantizers x centroids rows, so it and the distance tables made from it
have a size that the settings fix; they alone are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvex.config import QuantizerConfig
from corvex.errors import DimensionMismatch, EmptyCollection, IndexNotBuilt
from corvex.functions import vectors as V
from corvex.plans.knn import matrix, search, search_batch

SAMPLE = 65_536  # vectors that a codebook is trained on at most, taken by the hash of their id


def subvectors(df: DataFrame, config: QuantizerConfig, dim: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``id``, sq, sub): the contiguous slices of each vector."""
    w = config.width(dim)
    rows = df.where(F.col(vector).isNotNull()).select(id, vector, F.explode(F.sequence(F.lit(0), F.lit(config.subquantizers - 1))).alias("sq"))
    return rows.select(id, "sq", F.slice(vector, F.col("sq") * w + 1, w).alias("sub"))


def first_codebook(df: DataFrame, config: QuantizerConfig, dim: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A deterministic start: the subvectors of the first vectors by id."""
    first = df.where(F.col(vector).isNotNull()).select(id, vector).orderBy(id).limit(config.centroids)
    ranked = first.withColumn("code", F.row_number().over(Window.orderBy(id)) - 1)  # at most config.centroids rows
    w = config.width(dim)
    rows = ranked.select("code", vector, F.explode(F.sequence(F.lit(0), F.lit(config.subquantizers - 1))).alias("sq"))
    return rows.select("sq", "code", F.transform(F.slice(vector, F.col("sq") * w + 1, w), lambda x: x.cast("double")).alias("centroid"))


def _books(codebook: DataFrame, config: QuantizerConfig) -> np.ndarray:
    """The codebook as an array [sq, code, width]; subquantizers x centroids rows reach the driver."""
    rows = codebook.orderBy("sq", "code").collect()
    if not rows:
        raise IndexNotBuilt("the codebook is empty")
    return np.array([r["centroid"] for r in rows]).reshape(config.subquantizers, -1, len(rows[0]["centroid"]))


def encode(df: DataFrame, codebook: DataFrame, config: QuantizerConfig, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``id``, codes): of each subvector the nearest centroid, the first of equally near ones. One pass, no shuffle."""
    books = _books(codebook, config)
    held = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x) and x.shape[1] != books.shape[0] * books.shape[2]:
                raise DimensionMismatch(books.shape[0] * books.shape[2], x.shape[1])
            x = x.reshape(len(x), books.shape[0], books.shape[2])
            codes = np.zeros((len(x), books.shape[0]), np.int32)
            for s in range(books.shape[0]):
                for i in range(0, len(x), 1024):  # differences, not dot products: equal ones stay equal
                    codes[i : i + 1024, s] = ((x[i : i + 1024, s, None, :] - books[s][None]) ** 2).sum(axis=2).argmin(axis=1)
            ends = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))], names=["_id", "codes"])

    kind = df.schema[id].dataType.simpleString()
    return df.where(F.col(vector).isNotNull()).select(F.col(id).alias("_id"), F.col(vector).alias("_v")).mapInArrow(run, f"_id {kind}, codes array<int>").withColumnRenamed("_id", id)


def assign(subs: DataFrame, codebook: DataFrame, id: str = "vec_id") -> DataFrame:
    """(``id``, sq, code, d2) in SQL alone: subvectors joined to their subquantizer's centroids. The codebook's size is
    fixed by the settings, so it may be broadcast."""
    near = subs.join(F.broadcast(codebook), "sq").select(id, "sq", "code", V.squared_euclidean(F.col("sub"), F.col("centroid")).alias("d2"))
    return near.groupBy(id, "sq").agg(F.min(F.struct("d2", "code")).alias("b")).select(id, "sq", F.col("b.code").alias("code"), F.col("b.d2").alias("d2"))


def lloyd_step(subs: DataFrame, codebook: DataFrame, id: str = "vec_id") -> DataFrame:
    """The codebook after one assignment and averaging; a centroid without vectors stays where it was."""
    assigned = subs.join(assign(subs, codebook, id), [id, "sq"]).select("sq", "code", F.posexplode("sub").alias("i", "x"))
    means = assigned.groupBy("sq", "code", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy("sq", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("new"))
    return codebook.join(means, ["sq", "code"], "left").select("sq", "code", F.coalesce("new", "centroid").alias("centroid"))


def train(df: DataFrame, config: QuantizerConfig, dim: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(sq, code, centroid), by seeded k-means++ and Lloyd iterations, one subquantizer a task, on at most SAMPLE vectors
    (those with the lowest hash of their id). An empty table is an error."""
    seed = config.seed or 0
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) == dim))
    sample = rows.orderBy(F.xxhash64(id), id).limit(SAMPLE)
    if sample.isEmpty():
        raise EmptyCollection("no vectors to train on")
    w = config.width(dim)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        sq = int(pdf["sq"].iloc[0])
        pdf = pdf.sort_values(id)
        x = np.array(pdf["sub"].tolist(), dtype=np.float64)
        rng = np.random.default_rng(seed * 1_000_003 + sq)
        k = min(config.centroids, len(x))
        centers = np.empty((k, w))
        centers[0] = x[rng.integers(len(x))]
        near = np.sqrt(((x - centers[0]) ** 2).sum(axis=1))
        for c in range(1, k):
            total = near.sum()
            centers[c] = x[rng.choice(len(x), p=near / total)] if total > 0 else x[rng.integers(len(x))]
            near = np.minimum(near, np.sqrt(((x - centers[c]) ** 2).sum(axis=1)))
        for _ in range(config.iterations):
            d = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None]
            code = d.argmin(axis=1)
            count = np.bincount(code, minlength=k)
            sums = np.zeros((k, w))
            np.add.at(sums, code, x)
            full = count > 0
            centers[full] = sums[full] / count[full, None]
            for c in np.flatnonzero(~full):
                centers[c] = x[rng.integers(len(x))]
        return pd.DataFrame({"sq": sq, "code": np.arange(k), "centroid": list(centers)})

    return subvectors(sample, config, dim, id, vector).groupBy("sq").applyInPandas(fit, "sq int, code int, centroid array<double>")


def decode(codes: DataFrame, codebook: DataFrame, id: str = "vec_id") -> DataFrame:
    """(``id``, decoded): the centroids of the codes one after the other; a code that isn't in the codebook is an error."""
    parts = codes.select(id, F.posexplode("codes").alias("sq", "code")).join(F.broadcast(codebook), ["sq", "code"], "left")
    checked = F.coalesce("centroid", F.raise_error(F.lit("code not in the codebook")).cast("array<double>"))
    return parts.select(id, "sq", checked.alias("c")).groupBy(id).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sq", "c"))), lambda s: s["c"])).alias("decoded"))


def distance_table(codebook: DataFrame, query: Sequence[float], config: QuantizerConfig) -> DataFrame:
    """(sq, code, d2): squared distance of the query's subvectors to all centroids."""
    w = config.width(len(query))
    subs = F.slice(V.literal(query), F.col("sq") * w + 1, w)
    return codebook.select("sq", "code", V.squared_euclidean(subs, F.col("centroid")).alias("d2"))


def asymmetric(codes: DataFrame, codebook: DataFrame, query: Sequence[float], config: QuantizerConfig, id: str = "vec_id") -> DataFrame:
    """(``id``, distance): Euclidean distance of the query to the coded vectors, whatever the metric, by table lookup.

    The table is a literal array [sq][code]: subquantizers x centroids numbers in the plan, no join and no shuffle.
    """
    rows = distance_table(codebook, query, config).orderBy("sq", "code").collect()  # subquantizers x centroids rows
    tables: dict[int, list[float]] = {}
    for r in rows:
        tables.setdefault(r["sq"], []).append(r["d2"])
    lookup = F.array(*(V.literal(tables[s]) for s in sorted(tables)))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(config.subquantizers - 1)), F.lit(0.0), lambda s, i: s + F.get(F.get(lookup, i), F.get("codes", i)))
    return codes.select(id, F.sqrt(total).alias("distance"))


def two_level(df: DataFrame, codes: DataFrame, codebook: DataFrame, query: Sequence[float], config: QuantizerConfig, k: int = 10, rerank: int = 100, metric: str = "cosine", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``rerank`` nearest by code, ranked again by exact distance: (``id``, distance)."""
    near = asymmetric(codes, codebook, query, config, id).orderBy("distance", id).limit(rerank).select(id)
    return search(df.join(F.broadcast(near), id, "left_semi"), query, k, metric, id, vector)  # at most ``rerank`` rows


def two_level_batch(df: DataFrame, codes: DataFrame, codebook: DataFrame, queries: DataFrame, config: QuantizerConfig, k: int = 10, share: float = 0.1, metric: str = "cosine", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q_id, ``id``, distance, rank): for each stated query the nearest ``share`` of all by code, ranked again exactly.

    The decoded vectors stand for the codes, so one scan in blocks serves all queries; only its survivors' own vectors
    are joined.
    """
    most = max(k, ceil(share * codes.count()))
    near = search_batch(decode(codes, codebook, id), queries, most, "euclidean", id, "decoded").select("q_id", id)
    pairs = near.join(df.select(id, F.col(vector).alias("_v")), id).join(queries, "q_id")
    rows = pairs.select("q_id", id, V.distance(metric, F.col("q_vec"), F.col("_v")).alias("distance"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("distance", id))).where(f"rank <= {k}")


def reconstruction_error(df: DataFrame, decoded: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return df.join(decoded, id).select(id, V.euclidean(F.col(vector), F.col("decoded")).alias("error"))
