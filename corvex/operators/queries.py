"""Queries of the general operators for pipelines of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.operators import instants, shredding
from corvex.shared import once, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shredding.links(shredding.shred_events(table(spark, d, "webhook_events"), wide=False))


def _shredded(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all tables, shredded once for all queries over the same events."""
    return once(spark, f"{d}/webhook_events.parquet", "shredded", lambda: shredding.shred_events(table(spark, d, "webhook_events")), by="tbl")


def _table(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return shredding.table_of(_shredded(spark, d), name)

    return query


def p3_orphans(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of the tables point to a parent row that none of them has."""
    return shredding.orphans(_shredded(spark, d))


def p3_schema(spark: SparkSession, d: str) -> DataFrame:
    """The schema graph of the events' payloads as the data have it."""
    return shredding.schema_graph(_shredded(spark, d))


def _times(spark: SparkSession, d: str) -> DataFrame:
    tables = (("gitea_repos", "updated_at"), ("gitlab_projects", "last_activity_at"), ("bitbucket_repos", "updated_on"))
    one = lambda t, c: table(spark, d, t).select("record_id", F.col(c).alias("raw"), "host")
    rows = one(*tables[0])
    for t in tables[1:]:
        rows = rows.unionByName(one(*t))
    return instants.normalise_instants(rows, "record_id", "raw", "host", table(spark, d, "host_zones"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d).where("utc_us is not null").select("record_id", "utc_us").distinct()


def p7_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every record, also those whose string gives no moment, with the instant as a timestamp."""
    return _times(spark, d).select("record_id", "raw", F.timestamp_micros("utc_us").alias("instant")).distinct()


QUERIES = {"p3_found": p3_found, "p3_orphans": p3_orphans, "p3_schema": p3_schema, **{f"p3_{n}s": _table(n) for n in ("event", "change", "commit", "path", "change_of_file", "request", "label", "thread", "comment", "person")}, "p7_found": p7_found, "p7_instants": p7_instants}

ORACLE = {
    "p3_orphans": "select 0::bigint as orphans",
}
