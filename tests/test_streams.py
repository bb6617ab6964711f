from pyspark.sql import functions as F

from corvex.plans import sync
from corvex.streaming import events


def run(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, rows, schema, tmp_path, name):
    path = str(tmp_path / f"in-{name}")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_debounce_is_batch(spark, tmp_path):
    rows = [(1, 0), (1, 10), (1, 70), (2, 5), (1, 129), (1, 189), (2, 500)]
    df = spark.createDataFrame(rows, "repo long, s long").select("repo", F.timestamp_seconds("s").alias("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema("repo long, at timestamp").parquet(str(tmp_path / "d"))
    got = run(events.debounced(stream, "repo", "at", 60), "complete", tmp_path, "bursts")
    want = sync.debounced(df, "repo", "at", 60)
    assert got.count() == 5 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_anchored_limit(spark, tmp_path):
    stream = source(spark, [("a", 5.0), ("a", 10.0), ("a", 14.9), ("a", 15.0), ("b", 1.0)], "key string, at double", tmp_path, "limit")
    got = run(events.limited(stream, 10, 2), "append", tmp_path, "limit")
    assert {tuple(r) for r in got.collect()} == {("a", 5.0, 1, True), ("a", 10.0, 2, True), ("a", 14.9, 3, False), ("a", 15.0, 1, True), ("b", 1.0, 1, True)}


def test_repository_machine(spark, tmp_path):
    rows = [("r", 1.0, "sync", "c1"), ("r", 2.0, "indexed", None), ("s", 1.0, "sync", "c1"), ("s", 2.0, "indexed", None), ("s", 3.0, "sync", "c2"), ("t", 1.0, "error", "no host"), ("u", 1.0, "sync", "c"), ("u", 2.0, "indexed", None), ("u", 3.0, "sync", "c")]
    stream = source(spark, rows, "key string, at double, kind string, value string", tmp_path, "machine")
    got = {r.key: (r.last_commit, r.indexed, r.error, r.needs_reindex) for r in run(events.repository_states(stream), "update", tmp_path, "machine").collect()}
    assert got == {"r": ("c1", True, None, False), "s": ("c2", False, None, True), "t": (None, False, "no host", True), "u": ("c", True, None, False)}


def test_sync_loop_overwrites_named_indexes(spark, tmp_path):
    out = str(tmp_path / "index")
    spark.createDataFrame([(1, "a"), (2, "b")], "v long, index_name string").write.partitionBy("index_name").parquet(out)
    stream = source(spark, [("b",), ("b",), (None,)], "index_name string", tmp_path, "sync")
    events.sync_loop(stream, lambda named: named.withColumn("v", F.lit(9).cast("long")), out, str(tmp_path / "ck"), seconds=None).awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(out).select("v", "index_name").collect()} == {(1, "a"), (9, "b")}
