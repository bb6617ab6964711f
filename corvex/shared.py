"""The folder all executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvex.errors import InvalidConfig

_OWN: dict[str, str] = {}
_ONCE: dict[tuple, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (local tests) a
    folder of our own. On a cluster a missing setting is an error, as no machine's own folder is seen by the others."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise InvalidConfig("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="corvex-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then
        pass


def _state(spark: SparkSession, path: str) -> tuple:
    """Size and time of change of what lies at a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], by: str) -> DataFrame:
    """What ``build`` makes of the table at ``source``, written to the shared folder the first time in a program, by the
    values of ``by``, and read from there after that, as long as the source's size and time of change are the same."""
    key = (spark.sparkContext.applicationId, source, name, _state(spark, source))
    if key not in _ONCE:
        df = build()
        path = f"{shared_dir(spark)}/corvex-{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(by).parquet(path)
        atexit.register(_delete, spark, path)
        _ONCE[key] = path, df.schema
    path, schema = _ONCE[key]
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back: lineage ends there, and loss of an executor
    costs nothing. The files are removed by ``freed``, or when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvex-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvex_path = path
    return out


def freed(*tables: DataFrame) -> None:
    """Removes written tables that no plan needs any more, as those of a loop's earlier rounds."""
    for t in tables:
        if path := getattr(t, "_corvex_path", None):
            _delete(t.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
