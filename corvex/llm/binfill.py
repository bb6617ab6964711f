"""Filling containers of fixed capacity by minimum bin slack, on the histogram of sizes.

Sizes are whole numbers up to the capacity, so documents of one size are interchangeable and the whole corpus is, for
the packing, a histogram of at most ``capacity`` counts: that alone reaches the driver, whatever the number of
documents. For each bin a bitset subset-sum over the sizes still available finds the fullest feasible combination; the
combination is taken as often as the counts allow, so the number of searches follows the capacity, not the corpus.
Documents are then ranked within their size and joined to the bins by ranges of ranks.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def fullest(counts: dict[int, int], capacity: int, largest: int) -> list[int]:
    """The sizes of the fullest bin that holds one item of size ``largest``.

    Bit s of a row says that s can be filled. Sizes are taken in falling order; a size with count c enters as the
    binary parts of c, so a row is added for each part and the choice is read back from the last row.
    """
    chosen, room = [largest], capacity - largest
    mask = (1 << (room + 1)) - 1
    reach, rows = 1, []
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left = min(counts[size] - (size == largest), room // size)
        part = 1
        while left > 0:
            take = min(part, left)
            rows.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    fill = reach.bit_length() - 1
    for size, take, before in reversed(rows):
        if not before >> fill & 1:
            chosen += [size] * take
            fill -= size * take
    return chosen


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (sizes and how many of each, number of such bins), until every item is placed."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    out = []
    while counts:
        need = Counter(fullest(counts, capacity, max(counts)))
        times = min(counts[s] // n for s, n in need.items())
        out.append((dict(need), times))
        for s, n in need.items():
            counts[s] -= n * times
            if not counts[s]:
                del counts[s]
    return out


def fill_containers(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(``key``, part_no, token_from, token_to, container) for every item of a positive size.

    An item larger than ``capacity`` is cut into full parts, each a container of its own, and a remainder that is
    packed with the rest; nothing else is cut. Items of size null or 0 are left out; a repeated key counts once
    (its largest size). An empty table gives an empty result.
    """
    spark = sizes.sparkSession
    items = sizes.select(F.col(key).alias("_k"), F.col(size).cast("long").alias("_n")).where("_n > 0").groupBy("_k").agg(F.max("_n").alias("_n"))
    full = F.floor(F.col("_n") / capacity).cast("long")
    items = items.withColumn("_full", full).withColumn("_rest", F.col("_n") - F.col("_full") * capacity)
    rest = items.where("_rest > 0").select("_k", "_full", "_n", "_rest", F.pmod(F.xxhash64("_k"), F.lit(SALTS)).cast("int").alias("_salt"))

    # At most capacity x SALTS rows of counts.
    counted = rest.groupBy("_rest", "_salt").count().collect()
    histogram: Counter[int] = Counter()
    for r in counted:
        histogram[r["_rest"]] += r["count"]
    first: dict[tuple[int, int], int] = {}
    so_far: Counter[int] = Counter()
    for r in sorted(counted, key=lambda r: (r["_rest"], r["_salt"])):
        first[r["_rest"], r["_salt"]] = so_far[r["_rest"]]
        so_far[r["_rest"]] += r["count"]

    ranges, bins, used = [], 0, Counter()
    for need, times in patterns(histogram, capacity):
        for s, n in need.items():
            ranges.append((s, used[s], used[s] + n * times, bins, n))
            used[s] += n * times
        bins += times
    by_size: dict[int, list] = {}
    for s, *r in ranges:
        by_size.setdefault(s, []).append(r)
    starts = spark.createDataFrame([(s, x, n) for (s, x), n in first.items()], "_rest int, _salt int, _first long")
    plan = spark.createDataFrame(list(by_size.items()), "_rest int, _ranges array<array<long>>")

    # Rank within size and salt, then the salt's place within the size: no size, however common, is one task's.
    rank = F.row_number().over(Window.partitionBy("_rest", "_salt").orderBy("_k")) - 1
    placed = (
        rest.withColumn("_i", rank)
        .join(F.broadcast(starts), ["_rest", "_salt"])  # at most capacity x SALTS rows
        .join(F.broadcast(plan), "_rest")  # at most capacity rows; a pattern uses up a size, so there are few ranges
        .withColumn("_rank", F.col("_first") + F.col("_i"))
        .withColumn("_r", F.expr("filter(_ranges, r -> _rank >= r[0] and _rank < r[1])[0]"))
        .select(
            F.col("_k").alias(key),
            F.col("_full").cast("int").alias("part_no"),
            (F.col("_full") * capacity).alias("token_from"),
            F.col("_n").alias("token_to"),
            F.expr("_r[2] + (_rank - _r[0]) div _r[3]").alias("container"),
        )
    )
    # Full parts of oversized items: numbered after the packed bins by the same two-step ranking.
    over = items.where("_full > 0").withColumn("_salt", F.pmod(F.xxhash64("_k"), F.lit(SALTS)).cast("int"))
    at, offsets = bins, []
    for r in sorted(over.groupBy("_salt").agg(F.sum("_full").alias("n")).collect()):
        offsets.append((r["_salt"], at))
        at += r["n"]
    w = Window.partitionBy("_salt").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        over.withColumn("_before", F.coalesce(F.sum("_full").over(w), F.lit(0)))
        .join(F.broadcast(spark.createDataFrame(offsets, "_salt int, _at long")), "_salt")  # SALTS rows
        .withColumn("_p", F.explode(F.expr("sequence(0L, _full - 1)")))
        .select(
            F.col("_k").alias(key),
            F.col("_p").cast("int").alias("part_no"),
            (F.col("_p") * capacity).alias("token_from"),
            ((F.col("_p") + 1) * capacity).alias("token_to"),
            (F.col("_at") + F.col("_before") + F.col("_p")).alias("container"),
        )
    )
    return placed.unionByName(cut)
