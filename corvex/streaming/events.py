"""The incremental operators on streams: debouncing, rate limits, repository state, and index upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

WATERMARK = "10 minutes"  # later events are dropped
#: The state store that processors below need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def pushes(events: DataFrame, event_type: str = "event_type") -> DataFrame:
    from corvex.sources.repositories import is_push

    return events.where(is_push(F.col(event_type)))


def debounced(events: DataFrame, key: str, at: str, seconds: int, watermark: str = WATERMARK) -> DataFrame:
    """Bursts as in the batch form; in append mode a burst comes out once the watermark has passed its end."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)
    w = F.session_window(F.col(at), f"{seconds * 1_000_000 - 1} microseconds")  # windows that touch are merged
    return stamped.groupBy(key, w).agg(F.min(at).alias("started"), F.max(at).alias("last_event"), F.count("*").alias("n_events")).drop("session_window")


class AnchoredLimit(StatefulProcessor):
    """Windows of ``seconds`` that begin with the first request after the last one's end; the excess is flagged.

    Input: key, at (seconds). Output: key, at, position in the window, allowed.
    """

    def __init__(self, seconds: float, limit: int):
        self.seconds, self.limit = seconds, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "begin double, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at = sorted(t for pdf in rows for t in pdf["at"])
        begin, n = self.window.get() if self.window.exists() else (float("-inf"), 0)
        out = []
        for t in at:
            if t - begin >= self.seconds:
                begin, n = t, 0
            n += 1
            out.append((key[0], t, n, n <= self.limit))
        self.window.update((begin, n))
        yield pd.DataFrame(out, columns=["key", "at", "position", "allowed"])

    def close(self) -> None:
        pass


class RepositoryMachine(StatefulProcessor):
    """new -> synced -> indexed, with errors: a sync clears the error, and ``indexed`` too if the commit changed;
    needs_reindex if not indexed or failed. Of one moment, syncs come first, then indexed, then errors.

    Input: key, at (seconds), kind (sync, indexed or error), value (commit or message). Output: the state after each batch.
    """

    ORDER = {"sync": 0, "indexed": 1, "error": 2}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last_commit string, indexed boolean, error string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        commit, indexed, error = self.state.get() if self.state.exists() else (None, False, None)
        for r in sorted((tuple(x) for pdf in rows for x in pdf[["at", "kind", "value"]].itertuples(index=False)), key=lambda r: (r[0], self.ORDER.get(r[1], 3), str(r[2]))):
            _, kind, value = r
            if kind == "sync":
                commit, indexed, error = value, indexed and value == commit, None
            elif kind == "indexed":
                indexed, error = True, None
            elif kind == "error":
                error = value
        self.state.update((commit, indexed, error))
        yield pd.DataFrame([(key[0], commit, indexed, error, not indexed or error is not None)], columns=["key", "last_commit", "indexed", "error", "needs_reindex"])

    def close(self) -> None:
        pass


def limited(events: DataFrame, seconds: float, limit: int) -> DataFrame:
    schema = f"key {events.schema['key'].dataType.simpleString()}, at double, position long, allowed boolean"
    return events.groupBy("key").transformWithStateInPandas(AnchoredLimit(seconds, limit), schema, "append", "none")


def repository_states(events: DataFrame) -> DataFrame:
    schema = f"key {events.schema['key'].dataType.simpleString()}, last_commit string, indexed boolean, error string, needs_reindex boolean"
    return events.groupBy("key").transformWithStateInPandas(RepositoryMachine(), schema, "update", "none")


def sync_loop(events: DataFrame, rebuild: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, by: str = "index_name", seconds: int | None = 300) -> StreamingQuery:
    """Rebuilds the indexes that a batch of events names and overwrites their partitions alone; a batch that is run again
    gives the same files. ``seconds`` None runs over what there is and ends."""

    def batch(df: DataFrame, _: int) -> None:
        named = df.select(by).where(F.col(by).isNotNull()).distinct()
        if not named.isEmpty():
            rebuild(named).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
