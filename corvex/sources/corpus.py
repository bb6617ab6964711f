"""Files of a corpus: reading, filtering, cutting to size, chunks, and token-hash embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that a walk doesn't enter, besides those whose name starts with a dot.
SKIPPED = ("node_modules", "target")


def visible(path: Column) -> Column:
    """False for paths with a hidden or skipped component."""
    parts = F.split(path, "/")
    return ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED))


def last_extension(path: Column) -> Column:
    """Text after the last dot of the file name as it stands; empty without one, or if the name has no other dot than its first character."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Case-sensitive; no extension never matches, an empty list matches nothing."""
    return last_extension(path).isin(*extensions) if extensions else F.lit(False)


def read_files(spark: SparkSession, root: str, extensions: Sequence[str], index_name: str) -> DataFrame:
    """(index_name, path, content) of the visible text files under ``root``; those that aren't UTF-8 are skipped."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    at = F.regexp_replace("path", "^[a-z]+:/+", "/")
    rel = F.substr(at, F.length(F.lit(base)) + 2) if base.startswith("/") else at
    rows = raw.select(rel.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    return rows.where(visible(F.col("path")) & has_extension(F.col("path"), extensions) & F.col("content").isNotNull()).select(F.lit(index_name).alias("index_name"), "path", "content")


def counts_by_extension(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(last_extension(F.col(path)).alias("extension")).agg(F.count("*").alias("n_files"))


def snippet(text: Column, chars: int = 200) -> Column:
    return F.left(text, F.lit(chars))


def shortened(text: Column, chars: int = 500) -> Column:
    """At most ``chars`` characters, followed by three dots if that cut something off."""
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("..."))).otherwise(text)


def chunks(files: DataFrame, size: int = 512, overlap: int = 64, id: str = "file_id", text: str = "content") -> DataFrame:
    """(``id``, chunk_no, chunk): fixed windows of ``size`` characters, each starting ``overlap`` before the last one's end.

    Empty and null texts have none.
    """
    step = size - overlap
    rows = files.where(F.length(text) > 0).select(id, text, F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step).cast("int") - 1))).alias("chunk_no"))
    return rows.select(id, "chunk_no", F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"))


def hash_embedding(files: DataFrame, dim: int = 64, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, bucket, n): counts of a text's words by the hash of the word; a sparse embedding in SQL alone."""
    words = files.select(id, F.explode(F.split(F.lower(text), r"[^a-z0-9]+")).alias("word")).where("word <> ''")
    bucket = F.pmod(F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    return words.select(id, bucket.alias("bucket")).groupBy(id, "bucket").agg(F.count("*").alias("n"))


def hashed_counts(files: DataFrame, dim: int = 64, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, v): the same counts as a whole vector, without a shuffle; a null text has zeros."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    buckets = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))
    kind = files.schema[id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            rows = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            x = np.bincount(rows * dim + lists.flatten().to_numpy(), minlength=b.num_rows * dim).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x))], names=["_id", "v"])

    return files.select(F.col(id).alias("_id"), buckets.alias("_b")).mapInArrow(count, f"_id {kind}, v array<double>").withColumnRenamed("_id", id)


def embed(files: DataFrame, embedder: Callable[[list[str]], np.ndarray], dim: int, id: str = "doc_id", text: str = "text", batch: int = 32) -> DataFrame:
    """(``id``, embedding): any embedder of lists of texts, in batches; every text has a vector, a null one that of ''."""
    kind = files.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                x = np.asarray(embedder([t or "" for t in part.column(1).to_pylist()]), dtype=np.float32)
                if x.shape != (part.num_rows, dim):
                    raise ValueError(f"the embedder gave {x.shape} for {part.num_rows} texts of dimension {dim}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel()))], names=["_id", "embedding"])

    return files.select(F.col(id).alias("_id"), F.col(text).alias("_t")).mapInArrow(run, f"_id {kind}, embedding array<float>").withColumnRenamed("_id", id)


def masked_mean(hidden: np.ndarray, mask: np.ndarray, normalise: bool = True) -> np.ndarray:
    """Mean of the token vectors [n, tokens, dim] that the mask keeps, scaled to length 1."""
    m = mask[:, :, None].astype(np.float64)
    mean = (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    return mean / np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), 1e-12) if normalise else mean
