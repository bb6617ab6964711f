"""The catalogue of indexes and workspaces on storage: one JSON file for each, in folders any Hadoop file system holds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.schemas import INDEX_INFO, WORKSPACE_INFO
from corvex.sources import store

METADATA, WORKSPACE = "metadata.json", "workspace.json"


def _scan(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """What can be read of the files; one that is no JSON object, or names nothing, is left out."""
    try:
        rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(pattern)
    except AnalysisException:  # no such files yet
        return spark.createDataFrame([], schema)
    return rows.where("_bad is null and name is not null").drop("_bad")


def indexes(spark: SparkSession, root: str) -> DataFrame:
    """All indexes: ``root``/provider/owner/name/metadata.json."""
    return _scan(spark, f"{root.rstrip('/')}/*/*/*/{METADATA}", INDEX_INFO)


def workspaces(spark: SparkSession, root: str) -> DataFrame:
    """All workspaces: ``root``/workspaces/name/workspace.json."""
    return _scan(spark, f"{root.rstrip('/')}/workspaces/*/{WORKSPACE}", WORKSPACE_INFO)


def _write(spark: SparkSession, path: str, text: str) -> None:
    p, fs = store._path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def save(rows: DataFrame, root: str, kind: str = "index") -> int:
    """Writes each row's file, over the one that is there; returns how many. The rows are settings: indexes or
    workspaces that changed, read on the driver one by one."""
    base, n = root.rstrip("/"), 0
    for r in rows.select("name", F.to_json(F.struct("*"), {"pretty": "true"}).alias("j")).toLocalIterator():
        _write(rows.sparkSession, f"{base}/{r['name']}/{METADATA}" if kind == "index" else f"{base}/workspaces/{r['name']}/{WORKSPACE}", r["j"])
        n += 1
    return n


def delete(spark: SparkSession, root: str, name: str, kind: str = "index") -> bool:
    """Removes an index or a workspace with all it holds; what isn't there is no error."""
    return store.delete(spark, f"{root.rstrip('/')}/{name}" if kind == "index" else f"{root.rstrip('/')}/workspaces/{name}")
