"""Indexes on storage: parquet tables of nodes, codebooks and codes, and a one-row metadata table."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from corvex.errors import StorageError
from corvex.schemas import INDEX_METADATA

VERSION = 1


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Deleting what isn't there is no error."""
    p, fs = _path(spark, path)
    return fs.delete(p, True) if fs.exists(p) else False


def save(df: DataFrame, path: str, by: str | None = None) -> None:
    """Overwrites; with ``by`` only the partitions that ``df`` has."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(by)
    writer.parquet(path)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    if not exists(spark, path):
        raise StorageError(f"nothing at {path}")
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException as e:
        raise StorageError(str(e)) from e


def metadata(spark: SparkSession, num_vectors: int, dimension: int, description: str | None = None, now: int | None = None) -> DataFrame:
    at = int(time.time()) if now is None else now
    return spark.createDataFrame([(VERSION, num_vectors, dimension, at, at, description)], INDEX_METADATA)


def load_metadata(spark: SparkSession, path: str) -> dict:
    row = load(spark, path, INDEX_METADATA).first()
    if row is None or row["version"] != VERSION:
        raise StorageError(f"no index metadata of version {VERSION} at {path}")
    return row.asDict()
