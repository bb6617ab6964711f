"""Catalogue of indexes and workspaces, and the state of repositories from their history of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvex.errors import WorkspaceNotFound


def latest_states(history: DataFrame, key: str = "repo_key") -> DataFrame:
    """The last recorded row of each repository; repeated rows count once, ties go to the larger state_id."""
    columns = [c for c in history.columns if c != key]
    last = F.max_by(F.struct(*columns), F.struct(F.coalesce("recorded_at", F.lit(0).cast("timestamp")), "state_id"))
    return history.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("s")).select(key, "s.*")


def needs_reindex(indexed: Column, error: Column) -> Column:
    return ~F.coalesce(indexed, F.lit(False)) | error.isNotNull()


def commit_changes(history: DataFrame, key: str = "repo_key") -> DataFrame:
    """(``key``, state_id, before, after): rows whose commit differs from that of the row before; the first counts."""
    rows = history.where(F.col(key).isNotNull() & F.col("last_commit").isNotNull()).dropDuplicates([key, "state_id"])
    before = F.lag("last_commit").over(Window.partitionBy(key).orderBy("recorded_at", "state_id"))
    return rows.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("last_commit"))).select(key, "state_id", "before", F.col("last_commit").alias("after"))


def status(catalogue: DataFrame, states: DataFrame) -> DataFrame:
    """Each index with its repository's state, if any: (name, file_count, indexed, last_synced, error)."""
    s = states.select(F.col("repo_key").alias("name"), "indexed", "last_synced", "error")
    return catalogue.join(s, "name", "left").select("name", F.coalesce("file_count", F.lit(0).cast("bigint")).alias("file_count"), F.coalesce("indexed", F.lit(False)).alias("indexed"), "last_synced", "error")


def totals(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(F.count("*").alias("n_indexes"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))


def megabytes(size: Column) -> Column:
    return F.round(size / 1048576, 2)


def upsert(catalogue: DataFrame, changed: DataFrame, key: str = "name") -> DataFrame:
    """Replaced or new rows; an index that is built again keeps its created_at."""
    kept = catalogue.join(changed.select(key), key, "left_anti")
    born = catalogue.select(key, F.col("created_at").alias("_born"))
    new = changed.join(born, key, "left").withColumn("created_at", F.coalesce("_born", "created_at")).drop("_born")
    return kept.unionByName(new.select(*catalogue.columns))


def remove(catalogue: DataFrame, name: str, key: str = "name") -> DataFrame:
    return catalogue.where(~F.col(key).eqNullSafe(F.lit(name)))


def _workspace(workspaces: DataFrame, name: str) -> None:
    if workspaces.where(F.col("name") == name).isEmpty():
        raise WorkspaceNotFound(name)


def create_workspace(workspaces: DataFrame, name: str, path: str, now: Column | None = None) -> DataFrame:
    """One more workspace without repositories, in place of one of the same name."""
    at = F.current_timestamp() if now is None else now
    kind = workspaces.schema["repositories"].dataType.simpleString()
    new = workspaces.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(path).alias("path"), F.array().cast(kind).alias("repositories"), at.alias("created_at"), at.alias("updated_at"))
    return delete_workspace(workspaces, name).unionByName(new.select(*workspaces.columns))


def delete_workspace(workspaces: DataFrame, name: str, must: bool = False) -> DataFrame:
    if must:
        _workspace(workspaces, name)
    return workspaces.where(~F.col("name").eqNullSafe(F.lit(name)))


def list_workspaces(workspaces: DataFrame) -> DataFrame:
    """(name, n_repositories, updated_at)."""
    return workspaces.select("name", F.size(F.coalesce("repositories", F.array())).alias("n_repositories"), "updated_at")


def _changed(workspaces: DataFrame, name: str, repositories: Column, now: Column | None) -> DataFrame:
    hit, at = F.col("name") == name, F.current_timestamp() if now is None else now
    out = workspaces.withColumn("repositories", F.when(hit, repositories).otherwise(F.col("repositories")))
    return out.withColumn("updated_at", F.when(hit, at).otherwise(F.col("updated_at"))) if "updated_at" in workspaces.columns else out


def add_to_workspace(workspaces: DataFrame, name: str, repository: Column, now: Column | None = None) -> DataFrame:
    """Appends without removing doubles, and sets updated_at; a missing workspace is an error."""
    _workspace(workspaces, name)
    return _changed(workspaces, name, F.array_append(F.coalesce("repositories", F.array()), repository), now)


def remove_from_workspace(workspaces: DataFrame, name: str, full_name: str, now: Column | None = None) -> DataFrame:
    """Removes every repository of that full name, and sets updated_at; none there is an error."""
    held = workspaces.where(F.col("name") == name)
    _workspace(workspaces, name)
    if held.where(F.exists("repositories", lambda r: r["full_name"] == full_name)).isEmpty():
        raise WorkspaceNotFound(f"{full_name} in {name}")
    return _changed(workspaces, name, F.filter("repositories", lambda r: ~r["full_name"].eqNullSafe(F.lit(full_name))), now)


#: Kinds of file events that lead to a sync.
WATCHED = ("create", "modify", "remove")


def watched_events(events: DataFrame, root: str, path: str = "path", kind: str = "kind") -> DataFrame:
    """Adds ``root``, the repository folder of a changed file; other kinds of events and paths outside are left out."""
    rows = events.where(F.lower(kind).isin(*WATCHED)).withColumn("root", watched_root(F.col(path), root))
    return rows.where("root is not null")


def debounced(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """(``key``, started, last_event, n_events): bursts of events less than ``seconds`` apart; each fires once, that long
    after its last event. A gap of exactly ``seconds`` ends a burst."""
    w = F.session_window(F.col(at), f"{seconds * 1_000_000 - 1} microseconds")  # windows that touch are merged
    return events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, w).agg(F.min(at).alias("started"), F.max(at).alias("last_event"), F.count("*").alias("n_events")).drop("session_window")


def rate_windows(events: DataFrame, key: str, at: str, seconds: int = 3600, limit: int = 5000) -> DataFrame:
    """(``key``, window_start, n_events, over_limit) by windows aligned to the clock."""
    w = F.window(F.col(at), f"{seconds} seconds")
    counted = events.where(F.col(at).isNotNull()).groupBy(key, w).agg(F.count("*").alias("n_events"))
    return counted.select(key, F.col("window.start").alias("window_start"), "n_events", (F.col("n_events") > limit).alias("over_limit"))


def watched_root(path: Column, root: str) -> Column:
    """The repository folder (three levels under ``root``) of a changed file; null outside, above, or within ``.git``."""
    base = root.rstrip("/")
    rel = F.when(path.startswith(base + "/"), F.substr(path, F.lit(len(base) + 2)))
    parts = F.split(rel, "/")
    return F.when((F.size(parts) >= 4) & ~path.contains(".git"), F.concat_ws("/", F.lit(base), F.slice(parts, 1, 3)))


def last_turns(log: DataFrame, key: str, order: list[str], text: str, n: int = 10) -> DataFrame:
    """(``key``, context): the last n entries of each log, oldest first, joined by line breaks."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    rows = log.withColumn("_r", rank).where(f"_r <= {n}")
    lines = F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(text).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("context"))
