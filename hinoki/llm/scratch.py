"""Shared intermediate tables: lineage cuts that survive a lost executor."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Writes tables under one run folder and reads them back.

    The folder goes when the interpreter ends; ``drop`` frees a table earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._clean)

    def _clean(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the JVM may be gone by then
            pass

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read from the written files."""
        path, seen = self.path(name), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._hinoki_path, out._hinoki_rows = path, seen.get["rows"]
        return out

    @staticmethod
    def rows(df: DataFrame) -> int:
        """Rows of a table that ``table`` returned, counted while they were written."""
        return df._hinoki_rows

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_hinoki_path", None)
        if path:
            delete(self.spark, path)
