"""Long spans that occur verbatim in more than one document.

Every window of a text is hashed by Rabin-Karp. Counting all windows of the corpus would shuffle many times its size,
so they are counted in two steps that lose nothing. Each run of ``length`` characters is governed by its lowest hashed
window of ``anchor`` characters; equal runs have equal governors. Neighbouring runs under one governor make a segment.

1. Governors are counted, with the first and last document of each (pre-aggregated). Only segments whose governor is in
   two documents go on; they are counted again by the hash of the whole segment. A segment that two documents have
   is shared as it is.
2. For a segment that only one document has, while its governor is found elsewhere, every window of ``length``
   characters is hashed and counted, against those of each other segment of that governor: of one document's text, with
   the first and last document that have the segment.

The shared runs of a document are merged into maximal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvex.llm.rolling import Rolling, codes_of, mix, sliding_min
from corvex.shared import written

BLOCK = 400_000  # characters hashed at once
LOW = np.uint64((1 << 28) - 1)


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of some texts; of each text or part of a text its row's number in the batch, place in the block and
    offset in its text. Parts of a text longer than a block overlap by ``length - 1`` characters."""
    parts, size = [], 0

    def out():
        codes = np.concatenate([c for _, _, c in parts])
        sizes = np.array([len(c) for _, _, c in parts])
        return codes, np.array([k for k, _, _ in parts], object), np.cumsum(sizes) - sizes, np.array([o for _, o, _ in parts], np.int64)

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key is None or text is None or len(text) < length:
                continue
            codes = codes_of(text)
            for offset in range(0, len(codes) - length + 1, BLOCK):
                parts.append((key, offset, codes[offset : offset + BLOCK + length - 1]))
                size += len(parts[-1][2])
                if size >= BLOCK:
                    yield out()
                    parts, size = [], 0
    if parts:
        yield out()


def segments(codes: np.ndarray, begin: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each segment: hash of its governor, hash of itself, number of its text or part, first start there, starts."""
    roll = Rolling(codes)
    windows = roll.every(anchor)
    # The last of equal lowest hashes governs; the low bits hold the place, counted backwards.
    lowest = sliding_min((windows & ~LOW) | (LOW - np.arange(len(windows), dtype=np.uint64)), length - anchor + 1)
    governor = (LOW - (lowest & LOW)).astype(np.int64)
    whose = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(codes))))
    inside = whose[: len(governor)] == whose[length - 1 :]
    start = np.flatnonzero(inside)
    g = governor[start]
    new = np.ones(len(start), bool)
    new[1:] = (g[1:] != g[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    s1, s2, g = start[first], start[np.append(first[1:], len(start)) - 1], g[first]
    itself = mix(roll.at(s1, s2 - s1 + length) ^ mix((g - s1).astype(np.uint64)))
    return windows[g], itself, whose[s1], s1 - begin[whose[s1]], s2 - s1 + 1


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, anchor: int | None = None) -> DataFrame:
    """(``key``, span_start, span_end): maximal runs of positions that lie in some run of ``length`` characters found
    verbatim under another key. Positions are code points, from 0, end exclusive.

    Null, empty and shorter texts have no spans; rows with a null key take no part; a repeated row is the same
    document, not another one. Other columns are dropped first, so their names don't matter.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    anchor = anchor or length // 2 + 1
    kind = df.schema[key].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    docs = df.select(df[key].alias("_k"), df[text].alias("_t")).where(f"_k is not null and char_length(_t) >= {length}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, keys, begin, offset in _blocks(batches, length):
            fp, itself, part, start, n = segments(codes, begin, length, anchor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[part], arrow_key), pa.array(fp.view(np.int64)), pa.array(itself.view(np.int64)), pa.array((start + offset[part]).astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["_k", "fp", "seg", "start", "n"],
            )

    rows = docs.mapInArrow(cut, f"_k {kind}, fp long, seg long, start int, n int")
    ends = [F.min("_k").alias("k1"), F.max("_k").alias("k2")]
    common = rows.groupBy("fp").agg(*ends).where("k1 < k2").select("fp")
    rows = written(rows.join(common, "fp", "left_semi"), "segments")
    classes = rows.groupBy("fp", "seg").agg(*ends).withColumn("one", F.col("k1") == F.col("k2"))
    mixed = classes.groupBy("fp").agg(F.count("*").alias("m"), F.max("one").alias("any_one")).where("m > 1 and any_one").select("fp", F.lit(True).alias("look"))
    classes = classes.join(mixed, "fp", "left").select("fp", "seg", "k1", "k2", "one", F.coalesce("look", F.lit(False)).alias("look"))
    rows = written(rows.join(classes, ["fp", "seg"]).where("not one or look"), "classes")
    whole = rows.where("not one").select("_k", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b"))

    # One document's text for each segment of the governors that need a closer look; k2 stands for the others that have it.
    closer = rows.where("look and _k = k1").groupBy(F.col("_k").alias("_d")).agg(F.collect_set(F.struct("start", "n", "one", "k2")).alias("at"))
    texts = docs.join(closer, docs["_k"] == closer["_d"]).select("_k", "_t", "at")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            sizes = [len(h) for _, h, *_ in out]
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([k for k, *_ in out], object), sizes), arrow_key),
                    pa.array(np.concatenate([h for _, h, *_ in out])),
                    pa.array(np.concatenate([np.arange(a, a + m, dtype=np.int32) for (_, _, a, *_), m in zip(out, sizes)])),
                    pa.array(np.repeat(np.array([x[3] for x in out], bool), sizes)),
                    pa.array(np.repeat(np.array([x[4] for x in out], object), sizes), arrow_key),
                ],
                names=["_k", "h", "a", "one", "_k2"],
            )
            out.clear()
            return batch

        for batch in batches:
            for k, t, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for x in at:
                    roll = Rolling(codes_of(t[x["start"] : x["start"] + x["n"] - 1 + length]))
                    out.append((k, roll.every(length).view(np.int64), x["start"], x["one"], x["k2"]))
                    if len(out) >= 1000:
                        yield flush()
        if out:
            yield flush()

    windows = texts.mapInArrow(every, f"_k {kind}, h long, a int, one boolean, _k2 {kind}")
    found = windows.groupBy("h").agg(F.min("_k").alias("k1"), F.max("_k2").alias("k2"), F.max("one").alias("any_one")).where("k1 < k2 and any_one").select("h")
    single = windows.where("one").join(found, "h", "left_semi").select("_k", "a", (F.col("a") + length).alias("b"))

    order = Window.partitionBy("_k").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        whole.unionByName(single)
        .withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1))
        .withColumn("run", F.sum("new").over(order))
        .groupBy("_k", "run")
        .agg(F.min("a").alias("span_start"), F.max("b").alias("span_end"))
    )
    return merged.select(F.col("_k").alias(key), "span_start", "span_end")
