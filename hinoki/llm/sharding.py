"""Sharding by longest-processing-time scheduling (operator 7).

Groups that must stay together are sorted by size, and each goes to the least-loaded
shard through a heap. Groups of one size are interchangeable, so the heap takes sizes
with their numbers of groups: it says how many groups of a size each shard gets, and
the groups of a size are dealt out by their number. The loads are those of the schedule
over single groups. With T bytes in all there are at most X sizes up to X and T / X
groups above, hence at most 2 * sqrt(T) sizes, which is what the driver sees.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows, or groups, numbered by one task, about.
SLOT_ROWS = 50_000
#: A group with more than this part of all rows is joined by broadcast; there can only be so many.
OFTEN = 2000
#: Largest table of sizes that is broadcast; beyond it the join shuffles.
BROADCAST_SIZES = 500_000


def lpt(sizes: Iterable[tuple[object, int]], shards: int) -> dict[object, int]:
    """item -> shard. Ties go by item, then to the lower shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[item] = s
        heapq.heappush(heap, (load + size, s))
    return out


def lpt_counts(sizes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """(size, shards, upto) of each (size, number of groups): group number i of the size
    goes to the first of its shards with i < upto.

    The heap takes groups one by one while there are few of a size. Many are first spread
    so far that no shard can end up with fewer: rounds in which every shard that the
    least-loaded ones could still pass gets what fills it up to a common level.
    """
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, count in sorted(sizes, reverse=True):
        got = [0] * shards
        if count > 4 * shards and size > 0:
            # One whole round over all shards fewer than there is room for below the level.
            loads = sorted(heap)
            total = sum(load for load, _ in loads)
            k = shards
            while (total + count * size) / k <= loads[k - 1][0]:
                k -= 1
                total -= loads[k][0]
            level = (total + count * size) / k - 2 * size
            for load, s in loads[:k]:
                got[s] = max(0, int((level - load) // size))
            count -= sum(got)
            heap = [(load + got[s] * size, s) for load, s in loads]
            heapq.heapify(heap)
        for _ in range(count):
            load, s = heap[0]
            got[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        used = [s for s in range(shards) if got[s]]
        out.append((size, used, np.cumsum([got[s] for s in used]).tolist()))
    return out


def assign(docs: DataFrame, group: Column, size: Column, shards: int, order: Column) -> DataFrame:
    """``docs`` with __size, __shard and __slot, a gapless number within the shard.

    Rows with equal ``group`` (a string; null is one more group) share a shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    keyed = docs.withColumn("__group", F.coalesce(group, F.lit(""))).withColumn("__size", size.cast("long"))
    groups = scratch.table(keyed.groupBy("__group").agg(F.sum("__size").alias("size"), F.count("*").alias("n")), "groups")
    sizes = scratch.table(groups.groupBy("size").agg(F.count("*").alias("c"), F.sum("n").alias("n")), "sizes")
    known = sizes.select("size", "c").toArrow()
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    dealt = lpt_counts(zip(*(known.column(i).to_pylist() for i in range(2))), shards)
    table = pa.table([pa.array([d[0] for d in dealt], pa.int64()), pa.array([d[1] for d in dealt], pa.list_(pa.int32())), pa.array([d[2] for d in dealt], pa.list_(pa.int64()))], names=["size", "shards", "upto"])
    places = spark.createDataFrame(table)
    if len(dealt) <= BROADCAST_SIZES:
        places = F.broadcast(places)
    chunks = max([1, *(c // SLOT_ROWS for c in known.column("c").to_pylist())])
    numbered = _numbered(groups, "size", F.col("__group"), chunks, scratch)
    at = F.size(F.filter("upto", lambda x: x <= F.col("__number")))
    placed = numbered.join(places, "size").select("__group", "n", F.element_at("shards", at + 1).alias("__shard"))
    placed = scratch.table(placed, "placed")
    often = placed.filter(F.col("n") * OFTEN > rows).select("__group", "__shard")
    rare = placed.filter(F.col("n") * OFTEN <= rows).select("__group", "__shard")
    some = keyed.join(F.broadcast(often), "__group")
    rest = keyed.join(F.broadcast(often.select("__group")), "__group", "left_anti").join(rare, "__group")
    out = scratch.table(some.unionByName(rest), "rows")
    chunks = max(1, rows // (SLOT_ROWS * shards))
    return _numbered(out, "__shard", F.struct(order, F.col("__group")), chunks, scratch).withColumnRenamed("__number", "__slot")


def _numbered(df: DataFrame, key: str, order: Column, chunks: int, scratch: Scratch) -> DataFrame:
    """``df`` with __number, gapless from 0 among the rows of a key.

    Rows are numbered within chunks of a key, and shifted by the chunks before.
    """
    df = df.withColumn("__chunk", F.pmod(F.xxhash64(order), F.lit(chunks)))
    within = (F.row_number().over(Window.partitionBy(key, "__chunk").orderBy(order)) - 1).cast("long")
    if chunks == 1:
        return df.withColumn("__number", within).drop("__chunk")
    sizes = scratch.table(df.groupBy(key, "__chunk").agg(F.count("*").alias("c")), "chunks")
    before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(key, "__chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__before"))
    return df.withColumn("__in", within).join(shift, [key, "__chunk"]).withColumn("__number", F.col("__before") + F.col("__in")).drop("__chunk", "__in", "__before")


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; rows with equal texts share a shard.

    Size is the text's UTF-8 bytes plus 8. Null texts have no bytes and are one group;
    empty texts are another. Slots follow doc_id within a chunk; repeated rows get
    slots of their own; texts of any length count whole. A group larger than a fair shard
    stays whole and fills one shard alone. Columns other than id and text don't take part. An empty table gives
    an empty result.
    """
    text = F.col("text")
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    slim = src.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text.cast("binary"))).alias("key"))
    out = assign(slim, F.col("key"), F.col("size"), shards, F.col("doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
