"""What a worker process keeps from task to task, and what it gives back."""

from __future__ import annotations

import ctypes
import sys
import types

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.batches import BATCH_BYTES, BATCH_ROWS, bound_batches  # noqa: F401


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over batches of bounded size."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def process_cache() -> types.SimpleNamespace:
    """Things worth keeping between the tasks of one worker process."""
    return sys.modules.setdefault("_hinoki_process_cache", types.SimpleNamespace(files={}))


def release() -> None:
    """Give the memory of finished batches back to the system, where it can be done."""
    pa.default_memory_pool().release_unused()
    files = process_cache().files
    if "trim" not in files:
        try:
            files["trim"] = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # another C library
            files["trim"] = lambda pad: 0
    files["trim"](0)
