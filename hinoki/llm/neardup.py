"""MinHash near-duplicates from bottom-k sketches (operator 3).

One hash function ranks the word shingles of a text; its ``k`` smallest values are
the sketch. Inverted lists of retained values generate overlaps, the sketch of the
union estimates the similarity and filters, and the exact Jaccard similarity of the
full sets verifies. Two sets with similarity 3/4 miss each other in every list with
probability 4**-k at most, about 3e-39 for k = 64.

No list is ever expanded into all of its pairs while that can grow with its square:

1. equal sets become one node, whatever the number of copies;
2. in every list all members are compared with the list's smallest node (a star);
3. in lists of up to ``short`` nodes, remaining pairs in different components are compared;
4. longer lists are needed only by nodes whose sketch lies mostly in long lists (a
   linked pair shares at least 3/4 of either set, so a node with enough values in
   short lists meets all its partners there, see ``SATURATED``). Of those, the full
   sets tell how many values u of a node no other has: a pair shares n - u at most and
   its union has u more than the other set at least. Nodes and members that this
   bound rules out leave. The rest is described by its differences from a pivot, the
   list's member of least u: sizes of two sets, of their differences from the pivot
   and of the overlap of these differences give their similarity exactly. Pairs close
   enough without any overlap are linked through the node closest to the pivot; all
   others share a difference, and meet in its inverted list if the differences after
   it leave room for the overlap that they need. This is exact for whatever pivot.

A link inside a component changes nothing, so each step leaves out pairs that earlier
ones have connected. All pairs of a step are verified at once, or the best of each node
first if there are more pairs than nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .process import map_batches
from .scratch import Scratch
from .textkernel import shingle_sets, slices

#: Retained values of a sketch.
K = 64
#: Longest inverted list whose pairs are compared directly.
SHORT = 64
#: A node is compared in long lists if more than this share of its sketch lies in
#: them. Below it, at least 34 of 64 values are in short lists, and all of them would
#: have to be among the quarter that a partner may lack: probability about 1e-6.
SATURATED = 0.47
#: A pair goes on to verification if this share of the union's sketch is in both.
#: At similarity 3/4 a sample of 64 falls below it with probability about 1e-6.
PROMISING = 0.47
#: Largest table of ids, in rows, that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in (s for whole in batches for s in slices(whole, 1)):
            n, ids, low = [], [], []
            for s in shingle_sets(b.column(1), words):
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                low.append(s[:k].view(np.int64))
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in low]))).astype(np.int32)
            flat = np.concatenate(low) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=["doc_id", "n_shingles", "set_id", "sketch"])

    return map_batches(docs, run, "doc_id long, n_shingles long, set_id binary, sketch array<long>")


def _verified(pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of (a, b, text_a, text_b) the (a, b) whose full sets reach num/den."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2):
                hit = []
                for x, y in zip(shingle_sets(part.column(2), words), shingle_sets(part.column(3), words)):
                    both = np.sort(np.concatenate((x, y)))
                    shared = int((both[1:] == both[:-1]).sum())
                    hit.append(len(both) > 0 and den * shared >= num * (len(both) - shared))
                keep = pa.array(hit, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    return map_batches(pairs, run, "a long, b long")


def _full_sets(texts: DataFrame, words: int) -> DataFrame:
    """(a, v): every value of the full set of each (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole, 1)):
            sets = list(shingle_sets(b.column(1), words))
            owner = np.repeat(b.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(sets).view(np.int64))], names=["a", "v"])

    return map_batches(texts, run, "a long, v long")


def _differences(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(p, a, w, es) of (p, a, n, vs, cs, pvs, pcs).

    ``es`` holds the values that only one of node and pivot has, of the values that at
    least two nodes have (vs and pvs, their frequencies in cs and pcs), rarest first.
    Two nodes x and y of a pivot are linked if and only if w(x) + w(y) is at most
    2 * (den + num) times the number of values in both es.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in [whole.slice(i, 256) for i in range(0, whole.num_rows, 256)]):
            w, es = [], []
            n = b.column("n").to_pylist()
            vs, cs, pvs, pcs = ([np.asarray(x.values) for x in b.column(name)] for name in ("vs", "cs", "pvs", "pcs"))
            for size, v, c, pv, pc in zip(n, vs, cs, pvs, pcs):
                gained, lost = ~np.isin(v, pv), ~np.isin(pv, v)
                e = np.concatenate((v[gained], pv[lost]))
                rare = np.concatenate((c[gained], pc.max(initial=0) - pc[lost]))
                es.append(e[np.lexsort((e, rare))])
                w.append((den + num) * (size - len(v) + len(e)) - (den - num) * size)
            offs = np.concatenate(([0], np.cumsum([len(e) for e in es]))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *es])
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("a"), pa.array(w, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["p", "a", "w", "es"])

    return map_batches(groups.select("p", "a", "n", "vs", "cs", "pvs", "pcs"), run, "p long, a long, w long, es array<long>")


class _Search:
    """The state of one search: nodes, and their components so far."""

    def __init__(self, docs: DataFrame, words: int, num: int, den: int, k: int, short: int):
        self.docs, self.words, self.num, self.den, self.k, self.short = docs, words, num, den, k, short
        self.scratch = Scratch(docs.sparkSession, "neardup")
        self.labels: DataFrame | None = None

    # -- joins ----------------------------------------------------------------
    def _small(self, table: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(table) if rows <= BROADCAST_ROWS else table

    def by_key(self, rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
        """``rows`` with the one row that a written table has for their key, if any.

        A hot key never meets in one task: small tables are broadcast, and a join with
        others is written at once, as AQE splits skewed partitions of such joins only.
        """
        if self.scratch.rows(table) <= BROADCAST_ROWS:
            return rows.join(F.broadcast(table), key)
        return self.scratch.table(rows.join(table, key), "joined")

    # -- components ---------------------------------------------------------
    def label(self, df: DataFrame, node: str, name: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(name, F.col(node))
        at = self.labels.select(F.col("node").alias(node), F.col("label").alias("__l"))
        at = self._small(at, self.scratch.rows(self.labels))
        return df.join(at, node, "left").withColumn(name, F.coalesce("__l", node)).drop("__l")

    def merge(self, links: DataFrame) -> None:
        """Take the (a, b) of a written table as links."""
        rows = self.scratch.rows(links)
        if not rows:
            return
        if self.labels is not None:
            rows += self.scratch.rows(self.labels)
            links = links.union(self.labels.select("node", "label"))
        self.labels = components(links, self.scratch, rows)

    # -- pairs --------------------------------------------------------------
    def promising(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """(a, b, est) of the distinct (a, b) that the union's sketch lets through."""
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
        out = pairs.join(side("a"), "a").join(side("b"), "b").filter(self.den * F.least("n_a", "n_b") >= self.num * F.greatest("n_a", "n_b"))
        union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, self.k)
        out = out.select("a", "b", union.alias("u"), F.array_intersect("s_a", "s_b").alias("i"))
        return out.select("a", "b", (F.size(F.array_intersect("u", "i")) / F.size("u")).alias("est")).filter(F.col("est") >= PROMISING)

    def texts(self, ids: DataFrame, most: int) -> DataFrame:
        """(doc_id, text) of the distinct ids, ``most`` of them at most."""
        return self.docs.join(self._small(ids, most), "doc_id", "left_semi")

    def verify(self, pairs: DataFrame) -> None:
        """Compare the full sets of the (a, b) of a written table and take the links among them."""
        rows = self.scratch.rows(pairs)
        if not rows:
            return
        pairs = pairs.select("a", "b")
        side = lambda x: self.texts(pairs.select(F.col(x).alias("doc_id")).distinct(), rows).select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
        self.merge(self.scratch.table(_verified(both, self.words, self.num, self.den), "links"))

    def resolve(self, pairs: DataFrame, limit: int) -> None:
        """Verify the (a, b, est): all at once up to ``limit``, else the best of each node first.

        What the best connect needs no test any more, and a node's best is one pair, so
        the texts in flight stay in proportion to the nodes.
        """
        pending = self.scratch.table(pairs, "pairs")
        while self.scratch.rows(pending) > limit:
            best = pending.groupBy("a").agg(F.max(F.struct("est", -F.col("b"))).alias("top"))
            best = self.scratch.table(best.select("a", (-F.col("top.col2")).alias("b")), "best")
            self.verify(best)
            rest = self.label(self.label(pending.join(best, ["a", "b"], "left_anti"), "a", "la"), "b", "lb")
            rest = self.scratch.table(rest.filter("la <> lb").select("a", "b", "est"), "pairs")
            self.scratch.drop(pending)
            pending = rest
        self.verify(pending)

    # -- the whole search -----------------------------------------------------
    def run(self) -> DataFrame:
        """(doc_id, n_shingles, node, component_id) of every row of docs."""
        scratch = self.scratch
        sk = scratch.table(sketches(self.docs, self.words, self.k), "sketches")
        # Sets of several documents. Their table stands alone, so that AQE can split the join by a set of many.
        some = sk.filter("set_id is not null and doc_id is not null").groupBy("set_id")
        sets = scratch.table(some.agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).filter("c > 1").select("set_id", "least"), "sets")
        members = sk.join(self._small(sets, scratch.rows(sets)), "set_id", "left")
        members = members.withColumn("node", F.when(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")))
        members = scratch.table(members.select("doc_id", "n_shingles", "node", F.when(F.col("doc_id") == F.col("node"), F.col("sketch")).alias("sketch")), "members")
        scratch.drop(sk)
        # One or two shingles reach 3/4 with an equal set only.
        nodes = members.filter("sketch is not null and n_shingles > 2").select("node", F.col("n_shingles").alias("n"), "sketch")
        entries = nodes.select("node", F.explode("sketch").alias("v"))
        lists = scratch.table(entries.groupBy("v").agg(F.count("*").alias("c"), F.min("node").alias("b")).filter("c > 1"), "lists")
        entries = scratch.table(entries.join(lists, "v").select("v", "c", "b", F.col("node").alias("a")), "entries")
        limit = max(1, nodes.count())
        star = entries.filter("a <> b").select("a", "b").distinct()
        self.resolve(self.promising(star, nodes), limit)
        self.short_lists(entries, nodes, limit)
        self.long_lists(entries, nodes, limit)
        return self.label(members.select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node")), "node", "component_id")

    def short_lists(self, entries: DataFrame, nodes: DataFrame, limit: int) -> None:
        """Pairs in short lists whose ends are still in different components."""
        at = self.label(entries.filter(F.col("c") <= self.short).select("v", "a"), "a", "l")
        mixed = at.groupBy("v").agg(F.min("l").alias("x"), F.max("l").alias("y")).filter("x < y").select("v")
        at = self.scratch.table(at.join(mixed, "v").select("v", "a", "l"), "short")
        other = at.select("v", F.col("a").alias("b"), F.col("l").alias("m"))
        pairs = at.join(other, "v").filter("a > b and l <> m").select("a", "b").distinct()
        self.resolve(self.promising(pairs, nodes), limit)

    def least_elsewhere(self, at: DataFrame, key: str, value: str) -> tuple[DataFrame, Column]:
        """Rows of the written ``at`` whose group by ``key`` has several labels l, and the
        least ``value`` that another label has in the group."""
        least = at.groupBy(key, "l").agg(F.min(value).alias(value))
        one = self.scratch.table(least.groupBy(key).agg(F.min(F.struct(value, "l")).alias("one")), "one")
        two = self.by_key(least, one, key).filter("l <> one.l").groupBy(key).agg(F.min(value).alias("two"), F.first("one").alias("one"))
        two = self.scratch.table(two, "two")
        return self.by_key(at, two, key), F.when(F.col("l") == F.col("one.l"), F.col("two")).otherwise(F.col(f"one.{value}"))

    def long_lists(self, entries: DataFrame, nodes: DataFrame, limit: int) -> None:
        scratch = self.scratch
        long = entries.filter(F.col("c") > self.short)
        full = long.groupBy("a").agg(F.count("*").alias("hot")).join(nodes.select(F.col("node").alias("a"), F.size("sketch").alias("k")), "a").filter(F.col("hot") > SATURATED * F.col("k"))
        full = scratch.table(full.select(F.col("a").alias("doc_id")), "saturated")
        if not scratch.rows(full):
            return
        sets = scratch.table(_full_sets(self.texts(full, scratch.rows(full)), self.words), "sets")
        common = sets.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1").select("v")
        stats = sets.groupBy("a").agg(F.count("*").alias("n")).join(sets.join(common, "v").groupBy("a").agg(F.count("*").alias("s")), "a").select("a", "n", (F.col("n") - F.col("s")).alias("u"))
        stats = scratch.table(stats.filter(self.den * F.col("u") <= (self.den - self.num) * F.col("n")), "stats")
        at = scratch.table(self.label(self.by_key(long.select("v", "a"), stats, "a"), "a", "l"), "members")
        # Of a list's members those that the bound lets have a partner in another component.
        mine, other = self.least_elsewhere(at, "v", "u")
        mine = scratch.table(mine.filter(self.den * (F.col("n") - F.col("u")) >= self.num * (F.col("n") + other)).select("v", "a", "u"), "reach")
        pivots = scratch.table(mine.groupBy("v").agg(F.min(F.struct("u", "a")).alias("p")).select("v", F.col("p.a").alias("p")), "pivots")
        groups = scratch.table(self.by_key(mine, pivots, "v").select("p", "a").distinct(), "groups")
        if not scratch.rows(groups):
            return
        # Values of nodes that left are nobody's partner any more.
        sets = sets.join(self._small(groups.select("a").distinct(), scratch.rows(groups)), "a", "left_semi")
        common = sets.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
        shared = sets.join(common, "v").groupBy("a").agg(F.collect_list("v").alias("vs"), F.collect_list("c").alias("cs"))
        nothing = F.array().cast("array<long>")
        known = stats.select("a", "n").join(shared, "a", "left").select("a", "n", F.coalesce("vs", nothing).alias("vs"), F.coalesce("cs", nothing).alias("cs"))
        known = scratch.table(known, "known")
        pivot = known.select(F.col("a").alias("p"), F.col("vs").alias("pvs"), F.col("cs").alias("pcs"))
        apart = scratch.table(_differences(groups.join(known, "a").join(pivot, "p"), self.num, self.den), "differences")
        # Both ends so close to the pivot that they are linked: then both are linked with the closest.
        nearest = scratch.table(apart.groupBy("p").agg(F.min(F.struct("w", "a")).alias("m")).select("p", F.col("m.a").alias("b"), F.col("m.w").alias("w2")), "nearest")
        near = self.label(self.label(self.by_key(apart.select("p", "a", "w"), nearest, "p").filter("w + w2 <= 0 and a <> b"), "a", "l"), "b", "m")
        self.merge(scratch.table(near.filter("l <> m").select("a", "b").distinct(), "links"))
        self.resolve(self.promising(self.sharing_differences(apart), nodes), limit)

    def sharing_differences(self, apart: DataFrame) -> DataFrame:
        """The distinct (a, b) in different components whose differences may overlap enough."""
        unit = 2 * (self.den + self.num)
        at = self.scratch.table(self.label(apart, "a", "l"), "open")
        x, other = self.least_elsewhere(at, "p", "w")
        d = F.size("es").cast("long")
        x = x.filter(F.col("w") + other <= unit * d).select("p", "a", "w", "l", d.alias("d"), F.posexplode("es").alias("i", "e"))
        # Left over from the shared value on; the first value that two nodes share has room for all.
        x = self.scratch.table(x.select("p", "e", "a", "w", "l", (F.col("d") - F.col("i")).alias("rest")), "elements")
        y = x.select("p", "e", F.col("a").alias("b"), F.col("w").alias("w2"), F.col("l").alias("m"), F.col("rest").alias("rest2"))
        enough = F.col("w") + F.col("w2") <= unit * F.least("rest", "rest2")
        return x.join(y, ["p", "e"]).filter((F.col("a") > F.col("b")) & (F.col("l") != F.col("m")) & enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: tuple[int, int] = (3, 4), k: int = K, short: int = SHORT) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Texts are linked if shared >= num/den * union of their distinct word shingles;
    ``component_id`` is the smallest doc_id reachable and ``kept`` marks it.

    Null and empty texts, and texts without words, have an empty set and are linked
    with nothing. Texts of any length count whole. Rows that repeat a doc_id count as
    one document with several texts. Rows without a doc_id can't be named as
    anyone's partner: they are returned with a null component and kept. Other columns
    don't take part, whatever their names. An empty table gives an empty result.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = _Search(src, words, *similarity, k, short).run()
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that have a near duplicate with a smaller id.

    Rows that repeat a doc_id stay or go together; rows without one stay.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    scratch = Scratch(docs.sparkSession, "gone")
    gone = scratch.table(gone, "gone")
    if scratch.rows(gone) <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
