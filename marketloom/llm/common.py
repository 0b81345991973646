"""Session settings, shared storage and Arrow helpers for the text operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import passing, shared_dir, stored  # noqa: F401  the operators take them from here

#: Texts are handed to numpy in slices of at most this many bytes (one longer text is one slice).
SLICE_BYTES = 1 << 20
#: A table is broadcast only if its counted rows times their width stay under this.
BROADCAST_BYTES = 16 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches small enough for long texts."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def small_or_not(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted size allows it; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("shuffle_merge")


def counted(table: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table with the hint of ``small_or_not``, by a count of its rows."""
    return small_or_not(table, table.count(), row_bytes)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row starts and end within the slice, bytes) of consecutive whole rows."""
    at, data = raw(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, end, at[first : end + 1] - at[first], data[at[first] : at[end]]
        first = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
