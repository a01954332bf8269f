"""Texts of an Arrow batch as one byte array with offsets, without a Python object for each row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes and rows in an Arrow batch: with texts of any length a batch stays far below an executor's memory.
BATCH_BYTES, BATCH_ROWS = "4m", 50_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]] in UTF-8; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null(b"") if pa.types.is_large_binary(column.type) else column.fill_null("")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def is_space(b: np.ndarray) -> np.ndarray:
    """True at the bytes 20 and 09 to 0D."""
    return (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))


def lowered(b: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
