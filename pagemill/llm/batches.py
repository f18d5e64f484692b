"""Columns of Arrow batches as Python texts or as flat byte buffers, and settings that bound a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 500
BATCH_BYTES = 8 * 1024 * 1024


def bounded(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Texts are long: few rows and a byte bound per Arrow batch keep the memory of a Python worker flat."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def texts(column: pa.Array) -> list[str]:
    """A text column; null reads as empty."""
    return column.fill_null("").to_pylist() if column.null_count else column.to_pylist()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one buffer, and the offsets of the rows; null reads as empty."""
    whole = column.fill_null("") if column.null_count else column
    wide = pa.concat_arrays([whole.cast(pa.large_binary())])
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64, len(wide) + 1, wide.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def select(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name or type never travel."""
    return df.select(*[f"`{n}`" for n in names])
