"""Connected components: contraction within partitions, then alternating stars on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .process import map_batches
from .scratch import Scratch

#: Edges that one task contracts, about; a table of edges is read in parts of this size.
EDGES_PER_TASK = 250_000


def _forest(links: DataFrame, parts: int) -> DataFrame:
    """(u, v): each node's smallest node within its part. Keeps what is reachable from what."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent[x]
            return top

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        hung = [(x, root(x)) for x in parent if parent[x] != x]
        flat = np.array(hung, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["u", "v"])

    return map_batches(links.select("a", "b").coalesce(parts), run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of u on the smallest neighbour of u."""
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang u and its smaller neighbours on the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch, rows: int, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, label): label is the smallest node reachable, for nodes with a link.

    ``links`` has long columns a and b and ``rows`` rows at most. Every part of the edges is first contracted to
    a forest of stars on its own, which is the whole answer if there is one part. Then
    rounds of large and small stars, whose number is logarithmic, join the parts'
    forests until every edge points to a root. A star's edges meet by its centre in the
    joins of a round; AQE splits those that are too large for a task. After the first
    contraction a centre has at most one edge for each node and part.
    """
    parts = 1 + rows // edges_per_task
    edges = scratch.table(_forest(links, parts), "forest")
    while parts > 1:
        settled = edges.groupBy("u").count().filter("count > 1").select("u").union(edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u"))
        if settled.isEmpty():
            break
        star = scratch.table(_large_star(edges), "edges")
        new = scratch.table(_small_star(star), "edges")
        scratch.drop(edges)
        scratch.drop(star)
        edges = new
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out._hinoki_rows = scratch.rows(edges)
    return out
