"""Indexes from files to answers: add, sync, remove and search repositories by text.

An index is a folder ``root``/provider/owner/name with its files, its graph and its entry in the catalogue. It keeps no
vectors: a search computes those of the files it comes to, in batches, by the same embedder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.config import GraphConfig, IndexerConfig, probe
from corvex.errors import IndexNotBuilt, StorageError
from corvex.operators import flat, hnsw
from corvex.plans import knn, sync
from corvex.shared import written
from corvex.sources import catalogue, corpus, store

Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(dim: int = 64) -> Embedder:
    """An embedder without a model: counts of words by the hash of the word, scaled to length 1."""
    import re
    from hashlib import md5

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"[a-z0-9]+", text.lower()):
                out[i, int(md5(word.encode()).hexdigest()[:8], 16) % dim] += 1
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)

    return embed


def name_of(repository: dict) -> str:
    return f"{repository['provider']}/{repository['full_name']}"


def _identified(files: DataFrame, name: str) -> DataFrame:
    """(file_id, index_name, path, content): ids by index and path, so that a file keeps its id when others change."""
    return files.select(F.xxhash64(F.lit(name), "path").alias("file_id"), F.lit(name).alias("index_name"), "path", "content").where("path is not null").dropDuplicates(["file_id"])


def add(spark: SparkSession, root: str, repository: dict, files: DataFrame, embedder: Embedder, config: GraphConfig | None = None, batch: int = 32, commit: str | None = None) -> dict:
    """Builds the index of a repository from its files (path, content) and enters it in the catalogue; one that is there
    is replaced and keeps its created_at. Null contents count as empty. Returns the catalogue's entry."""
    config, name, dim = config or GraphConfig(), name_of(repository), probe(embedder)
    at = f"{root.rstrip('/')}/{name}"
    rows = _identified(files, name)
    store.save(rows, f"{at}/files")
    rows = store.load(spark, f"{at}/files")
    vectors = written(corpus.embed(rows, embedder, dim, id="file_id", text="content", batch=batch), "vectors")
    store.save(flat.build(vectors, config, id="file_id"), f"{at}/graph")
    n = rows.count()
    store.save(store.metadata(spark, n, dim, commit), f"{at}/meta")
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    known = catalogue.indexes(spark, root)
    entry = (name, at, tuple(repository.get(f.name) for f in known.schema["repository"].dataType), now, now, n, flat.estimated_bytes(n, dim))
    changed = spark.createDataFrame([entry], known.schema)
    catalogue.save(sync.upsert(known.where(F.col("name") == name), changed), root)
    return dict(zip(known.columns, entry))


def needs_sync(spark: SparkSession, root: str, name: str, commit: str | None) -> bool:
    """True for an index that isn't there, or was built from another commit."""
    try:
        return store.load_metadata(spark, f"{root.rstrip('/')}/{name}/meta")["description"] != commit
    except StorageError:
        return True


def sync_all(spark: SparkSession, root: str, repositories: Sequence[tuple[dict, str | None, Callable[[], DataFrame]]], embedder: Embedder, settings: IndexerConfig | None = None, config: GraphConfig | None = None) -> dict[str, str]:
    """Rebuilds the indexes whose commit changed, as many at a time as the settings allow: (repository, commit, reader of
    its files). Returns what became of each: ``current``, ``built`` or the error; one that fails doesn't stop others."""
    settings = settings or IndexerConfig()

    def one(item: tuple[dict, str | None, Callable[[], DataFrame]]) -> tuple[str, str]:
        repository, commit, files = item
        try:
            if not needs_sync(spark, root, name_of(repository), commit):
                return name_of(repository), "current"
            add(spark, root, repository, files(), embedder, config, commit=commit)
            return name_of(repository), "built"
        except Exception as e:
            return name_of(repository), f"error: {e}"

    with ThreadPoolExecutor(settings.max_concurrent_syncs) as pool:
        return dict(pool.map(one, repositories))


def remove(spark: SparkSession, root: str, name: str) -> bool:
    """Removes the index and its entry; False if there was none."""
    return catalogue.delete(spark, root, name)


def search(spark: SparkSession, root: str, texts: Sequence[str], embedder: Embedder, k: int = 10, names: Sequence[str] | None = None, workspace: str | None = None, config: GraphConfig | None = None, batch: int = 64) -> DataFrame:
    """(q_id, score, index, path, snippet): the k best files for each text, by its place in ``texts``.

    ``names`` restricts to these indexes, unknown ones are ignored; a workspace takes the place of ``names``, and a
    missing one is an error. Vectors are computed in batches for the files that the search comes to, not for others;
    without ``config`` a step expands 16 results of each text, so that there are few steps.
    """
    known = catalogue.indexes(spark, root)
    if workspace is not None:
        known = knn.in_workspace(known, catalogue.workspaces(spark, root), workspace, "name")
    elif names is not None:
        known = knn.in_indexes(known, names, "name")
    paths = [r["path"] for r in known.select("path").distinct().toLocalIterator()]  # one row for each index
    empty = spark.createDataFrame([], "q_id long, score double, index string, path string, snippet string")
    if not paths or not texts:
        return empty
    graph = spark.read.schema(flat.SCHEMA).parquet(*(f"{p}/graph" for p in paths))
    files = spark.read.schema("file_id long, index_name string, path string, content string").parquet(*(f"{p}/files" for p in paths))
    x, dim = embedder(list(texts)), probe(embedder)
    queries = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "q_id long, q_vec array<float>")

    def fetch(wanted: DataFrame) -> DataFrame:
        rows = files.join(wanted.withColumnRenamed("_n", "file_id"), "file_id", "left_semi")
        return corpus.embed(rows, embedder, dim, id="file_id", text="content", batch=batch).toDF("_n", "_v")

    try:
        found, _ = hnsw.beam_search(graph, fetch, queries, flat.entries(graph), k, config or GraphConfig(beam_width=16), id="node_id")
    except IndexNotBuilt:
        return empty
    return knn.hits(found, files.select(F.col("file_id"), "path", "content", "index_name"), id="node_id")


def status(spark: SparkSession, root: str, states: DataFrame) -> DataFrame:
    """Each index of the catalogue with its repository's last state."""
    return sync.status(catalogue.indexes(spark, root), sync.latest_states(states))
