"""Tables as Arrow batches of bounded size in enough partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of the Arrow batches that go to Python, unless the session says otherwise.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", f"{BATCH_BYTES}b")}


def bound_batches(spark: SparkSession) -> None:
    """Make Arrow batches small where the session has Spark's defaults.

    Ten thousand documents can be any number of bytes, in the JVM and in Python.
    """
    for key, (default, ours) in _DEFAULTS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew where it has too few partitions, as analysis is CPU-bound.

    Files in about as many partitions as there are cores take two rounds, or wait for the
    largest; so they get four a core. Tables of the session need one a core. Telling the
    partitions after a shuffle would run it, so those stay.
    """
    if df.isStreaming:
        return df
    plan, cores = df._jdf.queryExecution().executedPlan().toString(), df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan or df.rdd.getNumPartitions() >= (4 * cores if "FileScan" in plan else cores):
        return df
    return df.repartition(4 * cores)


def map_dealt(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over a dealt table in bounded batches."""
    bound_batches(df.sparkSession)
    return dealt(df).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of a text column; a longer text stands alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end
