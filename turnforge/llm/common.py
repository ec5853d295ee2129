"""Helpers the operators share: table reading, written intermediates, Arrow chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnforge.session import scratch_path, stored

__all__ = ["chunks", "fold_of", "read", "scratch_path", "stored", "with_key"]

#: Bytes of text that one numpy pass works on; bounds a task's memory (a longer single text is one pass).
CHUNK_BYTES = 1 << 21


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def with_key(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, row_hash): the columns an operator works on, whatever else the table has.

    Rows are told apart by (doc_id, row_hash): a repeated id with another text
    is a row of its own, a fully repeated row gets the same result twice.
    """
    key = F.col(doc_id)
    if doc_id != "doc_id" or dict(docs.dtypes)[doc_id] != "bigint":  # an alias would keep Spark from sharing exchanges
        key = key.cast("long").alias("doc_id")
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row_hash", F.hash("text"))


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy; nulls are empty."""
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, wide)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about ``limit`` bytes; whole texts only."""
    buf, off = string_buffer(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi
