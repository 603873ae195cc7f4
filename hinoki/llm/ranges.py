"""Id ranges: a total order over many tasks without a sampled range exchange."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a table, as far as its files tell, that one range holds, about.
RANGE_BYTES = 128 << 20


def count(df: DataFrame, wanted: int | None = None) -> int:
    """Number of ranges: the shuffle partitions of the session, or more for a large table."""
    if wanted:
        return wanted
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # Spark's answer for what it can't tell is the largest long
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES) if known else 1)


def bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending cuts that deal the rows of a long column evenly, from that column alone."""
    if n < 2:
        return []
    return sorted({int(x) for x in df.approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n)})


def number(key: Column, cuts: list[int]) -> Column:
    """How many cuts are below the key; 0 for null.

    The cuts stand in blocks of about the square root of their number, so a row looks at
    the last of each block and then into one block.
    """
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda xs: F.size(F.filter(xs, lambda x: x < key))
    full = below(F.lit([b[-1] for b in blocks]).cast("array<bigint>"))
    inside = F.try_element_at(F.array(*[F.lit(b).cast("array<bigint>") for b in blocks]), full + 1)
    return F.when(key.isNull(), 0).otherwise(F.least(F.lit(len(cuts)), full * step + F.greatest(F.coalesce(below(inside), F.lit(0)), F.lit(0)))).cast("int")
