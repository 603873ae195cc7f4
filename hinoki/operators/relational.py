"""The lattice as tables, for inspection and for checking the kernel.

A text's nodes and edges are found within its row, for many texts at once, so they need no
shuffle; connection costs and best paths are joins and folds over them. Positions are 0-based
code-point offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import map_dealt, slices
from ..functions.charclass import Categories, can_begin
from ..plans.dictionary import INHIBITED

NODE = ("at", "end", "surface", "left_id", "right_id", "cost", "dict_id", "word_id", "pos_id", "node_ord")
_ENTRY = ("dict_id", "word_id", "left_id", "right_id", "cost", "pos_id")


class _Lexicon:
    """Headwords with their entries, each headword's side by side."""

    def __init__(self, lexicon: DataFrame):
        """Like any broadcast the lexicon passes through the driver; columns that it lacks are 0."""
        columns = [c for c in (*_ENTRY, "surface") if c in lexicon.columns]
        rows = sorted(lexicon.filter("headword is not null").select("headword", *columns).collect(), key=lambda r: r[0])
        self.surface = [r["surface"] if "surface" in columns else r[0] for r in rows]
        self.entry = {c: np.array([r[c] if c in columns else 0 for r in rows], np.int32) for c in _ENTRY}
        heads = [r[0] for r in rows]
        self.group = {h: i for i, h in enumerate(dict.fromkeys(heads))}
        self.first = np.searchsorted(np.array([self.group[h] for h in heads], np.int64), np.arange(len(self.group) + 1))


@dataclass
class _Nodes:
    """Nodes of several texts by text and order of insertion; begins and ends are offsets in the joined texts."""

    whole: str
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    entry: np.ndarray

    @classmethod
    def of(cls, texts: Sequence[str | None], cats: Categories, lexicon: _Lexicon, longest: int, simple: bool) -> _Nodes:
        texts = [t or "" for t in texts]
        whole = "".join(texts)
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        new = can_begin(cats.of(whole))
        new[first[first < len(whole)]] = True
        starts = np.flatnonzero(new)
        bounds = np.append(starts, len(whole))  # the beginnings after a position, and the ends
        row = np.searchsorted(first, starts, "right") - 1
        get, i, hits = lexicon.group.get, np.arange(len(starts)), []
        for ahead in range(1, longest + 1):
            i = i[i + ahead < len(bounds)]
            i = i[(bounds[i + ahead] - starts[i] <= longest) & (bounds[i + ahead] <= first[row[i] + 1])]
            if not len(i):
                break
            spans = zip(starts[i].tolist(), bounds[i + ahead].tolist())
            group = np.fromiter((get(whole[a:b], -1) for a, b in spans), np.int64, len(i))
            found = np.flatnonzero(group >= 0)
            n = lexicon.first[group[found] + 1] - lexicon.first[group[found]]
            entry = np.repeat(lexicon.first[group[found]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(i[found], n)
            hits.append((at, bounds[at + ahead], entry))
        if simple:
            bare = np.ones(len(starts), bool)
            for at, *_ in hits:
                bare[at] = False
            at = np.flatnonzero(bare)
            hits.append((at, bounds[at + 1], np.full(len(at), -1)))
        at, end, entry = (np.concatenate([h[k] for h in hits]).astype(np.int64) if hits else np.zeros(0, np.int64) for k in range(3))
        # A simple node stands alone at its position.
        known = np.maximum(entry, 0)
        keys = [lexicon.entry[c][known] if len(lexicon.surface) else entry for c in ("word_id", "dict_id")]
        order = np.lexsort((keys[0], end, keys[1], at))
        at, end, entry = at[order], end[order], entry[order]
        return cls(whole, first, starts[at], end, row[at], entry)

    def order(self) -> np.ndarray:
        """Numbers from 1 on within each text."""
        return np.arange(1, len(self.row) + 1) - np.searchsorted(self.row, self.row)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of each node and of the nodes after it."""
        low, high = (np.searchsorted(self.begin, self.end, side) for side in ("left", "right"))
        n = np.where(self.end < self.first[self.row + 1], high - low, 0)
        return np.repeat(np.arange(len(n)), n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _mapped(texts: DataFrame, lexicon: DataFrame, key: str, longest: int, simple: bool, types: dict[str, str], columns: Callable[[_Nodes, _Lexicon], tuple[np.ndarray, list]]) -> DataFrame:
    """(key, the columns): ``columns`` returns the row of each output row and the values."""
    src = texts.select(F.col(key), F.col("text").alias("text"))
    kept, cats = texts.sparkSession.sparkContext.broadcast(_Lexicon(lexicon)), Categories()
    schema = T.StructType([src.schema[key], *(T.StructField(n, T.StringType() if t == "string" else T.IntegerType()) for n, t in types.items())])
    arrow = [pa.string() if t == "string" else pa.int32() for t in types.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept.value
        for batch in batches:
            for b in slices(batch, 1):
                nodes = _Nodes.of(b.column(1).to_pylist(), cats, own, longest, simple)
                row, made = columns(nodes, own)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *(pa.array(x, t) for x, t in zip(made, arrow))], names=schema.names)

    return map_dealt(src, run, schema)


def prefix_join(texts: DataFrame, lexicon: DataFrame, key: str, longest: int) -> DataFrame:
    """(key, at, end, word_id): every headword that starts at a word beginning and ends at one or at the end.

    ``longest`` bounds the substrings looked up at each position.
    """

    def columns(n: _Nodes, own: _Lexicon) -> tuple[np.ndarray, list]:
        base = n.first[n.row]
        return n.row, [n.begin - base, n.end - base, own.entry["word_id"][n.entry]]

    return _mapped(texts, lexicon, key, longest, False, {"at": "int", "end": "int", "word_id": "int"}, columns)


def lattice_nodes(texts: DataFrame, lexicon: DataFrame, key: str, longest: int, oov_cost: int, oov_pos: int, fields: Sequence[str] = NODE) -> DataFrame:
    """Lexicon nodes, and one up to the next word beginning wherever the lexicon has none.

    As the only provider of unknown words it is the fallback too, so it also serves characters
    that don't begin unknown words otherwise. ``node_ord`` is the order of insertion.
    """
    unknown = {"left_id": 0, "right_id": 0, "cost": oov_cost, "dict_id": -1, "word_id": -1, "pos_id": oov_pos}

    def values(name: str, n: _Nodes, own: _Lexicon) -> Sequence:
        if name in unknown:
            return np.append(own.entry[name], unknown[name])[n.entry]  # entry -1 is the last
        if name == "surface":
            return [own.surface[e] if e >= 0 else n.whole[a:b] for e, a, b in zip(n.entry.tolist(), n.begin.tolist(), n.end.tolist())]
        return n.order() if name == "node_ord" else (n.begin if name == "at" else n.end) - n.first[n.row]

    return _mapped(texts, lexicon, key, longest, True, {f: "string" if f == "surface" else "int" for f in fields}, lambda n, own: (n.row, [values(f, n, own) for f in fields]))


def lattice_edges(texts: DataFrame, lexicon: DataFrame, connection: DataFrame, key: str, longest: int) -> DataFrame:
    """(key, from_ord, to_ord, conn): connectable neighbours of ``lattice_nodes``, inhibited ones left out."""

    def columns(n: _Nodes, own: _Lexicon) -> tuple[np.ndarray, list]:
        (a, b), order = n.pairs(), n.order()
        ids = {c: np.append(own.entry[c], 0)[n.entry] for c in ("left_id", "right_id")}
        return n.row[a], [order[a], order[b], ids["right_id"][a], ids["left_id"][b]]

    pairs = _mapped(texts, lexicon, key, longest, True, {"from_ord": "int", "to_ord": "int", "left": "int", "right": "int"}, columns)
    # By a sorted join all edges would go to the few pairs of ids.
    cost = F.broadcast(connection.select("left", "right", F.col("cost").alias("conn")))
    return pairs.join(cost, ["left", "right"], "left").select(key, "from_ord", "to_ord", F.coalesce("conn", F.lit(0)).alias("conn")).filter(F.col("conn") != INHIBITED)


def viterbi(nodes: DataFrame, connection: DataFrame, key: str) -> DataFrame:
    """(key, total, path): cost of the best path and the node_ord of its nodes, one fold over each text's sorted nodes.

    Of equally cheap nodes before it a node takes the one inserted first. The fold keeps
    nodes that end at or after the present position only. It is for checking the kernel:
    the array holds one text's whole lattice.
    """
    table = F.broadcast(connection.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(",", "left", "right"), "cost"))).alias("matrix")))
    per = nodes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node_ord", "at", "end", "left_id", "right_id", F.col("cost").cast("long").alias("cost")))).alias("ns"), F.max("end").alias("n"))
    # One row of connection costs beside each text.
    per = per.join(table, F.col("n").isNotNull())
    state = "array<struct<end:int,right_id:int,total:bigint,node_ord:int,path:array<int>>>"
    conn = lambda r, left: F.coalesce(F.try_element_at("matrix", F.concat_ws(",", r, left)), F.lit(0))

    def best(acc: Column, at: Column, left_id: Column) -> Column:
        near = F.filter(acc, lambda p: (p["end"] == at) & (conn(p["right_id"], left_id) != INHIBITED))
        return F.array_min(F.transform(near, lambda p: F.struct((p["total"] + conn(p["right_id"], left_id)).alias("total"), p["node_ord"].alias("node_ord"), p["path"].alias("path"))))

    def step(acc: Column, n: Column) -> Column:
        low = best(acc, n["at"], n["left_id"])
        path = F.concat(low["path"], F.array(n["node_ord"].cast("int")))
        new = F.array(F.struct(n["end"].alias("end"), n["right_id"].alias("right_id"), (low["total"] + n["cost"]).alias("total"), n["node_ord"].cast("int").alias("node_ord"), path.alias("path"))).cast(state)
        open_ends = F.filter(acc, lambda p: p["end"] >= n["at"])
        return F.when(low.isNull(), open_ends).otherwise(F.concat(open_ends, new))

    start = F.array(F.struct(F.lit(0).alias("end"), F.lit(0).alias("right_id"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("node_ord"), F.array().cast("array<int>").alias("path"))).cast(state)
    done = per.select(key, "n", "matrix", F.aggregate("ns", start, step).alias("acc"))
    return done.select(key, best(F.col("acc"), F.col("n"), F.lit(0)).alias("b")).select(key, "b.total", "b.path")
