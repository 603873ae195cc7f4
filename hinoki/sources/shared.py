"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_PRIVATE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a private folder serves a session in one process, as in tests. On
    a cluster the executors have no folder in common with the driver, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _PRIVATE.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='hinoki-shared-')}")
    return found.rstrip("/")
