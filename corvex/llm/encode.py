"""Token ids and token counts of a text column by a public tokenizer, one pass and no shuffle."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvex.llm.rankbpe import encoder, vocabulary

BATCH_CHARS = 2_000_000


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch of about ``BATCH_CHARS``, so that a worker's memory doesn't follow the length of the texts."""
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_CHARS or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def token_ids(df: DataFrame, key: str, text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``key`` and ``ids``: the token ids of ``text``, special tokens read as ordinary text.

    A null or empty text gives an empty list, never null. Repeated rows come out as often as they came in; null keys
    are kept; other columns, whatever their names, are dropped before the pass.
    """
    path = vocabulary(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part, texts in _pieces(batch, "_text"):
                flat, ends, ids = array("i"), [0], []
                for x in texts:
                    encode.extend(ids, x)
                    if len(ids) > 100_000:
                        flat.extend(ids)
                        ids.clear()
                    ends.append(len(flat) + len(ids))
                flat.extend(ids)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["_key", "ids"])

    keys = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("_key"), df[text].alias("_text")).mapInArrow(run, f"_key {keys}, ids array<int>")
    return out.withColumnRenamed("_key", key)


def token_counts(df: DataFrame, key: str, text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens``; 0 for a null or empty text."""
    path = vocabulary(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part, texts in _pieces(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode.count(x) for x in texts], pa.int32())], names=["_key", "n_tokens"])

    keys = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("_key"), df[text].alias("_text")).mapInArrow(run, f"_key {keys}, n_tokens int")
    return out.withColumnRenamed("_key", key)
