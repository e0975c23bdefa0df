"""What one Arrow batch of whole texts may hold in a Python worker, and giving its memory back."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows in an Arrow batch: texts may be long, so batches are small.
ARROW_ROWS = 256

_libc = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def tidy() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)
