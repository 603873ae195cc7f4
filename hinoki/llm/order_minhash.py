"""Document fingerprints by Order MinHash (operator 4).

The k-mers of a text are numbered by occurrence, so that each is unique. For each of
``sketches`` hash functions the ``keep`` smallest are selected, put back into text
order, and hashed as a tuple. The share of equal positions of two signatures follows
their edit distance: it drops when k-mers change and when they change order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges
from .process import map_batches
from .textkernel import U64, mix

KMER, SKETCHES, KEEP = 6, 24, 2
_MULTIPLIERS = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_ROLL = 0x9FB21C651E98DF25
#: Products made at once; they should stay in a core's cache.
_AT_ONCE = 1 << 16


def numbered_kmers(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each (k-mer, occurrence), in text order; shorter texts are one k-mer."""
    n = len(points)
    if n == 0:
        return np.zeros(0, U64)
    k = min(k, n)
    m = n - k + 1
    with np.errstate(over="ignore"):
        p = points.astype(U64) + U64(1)
        h = p[:m].copy()
        for j in range(1, k):
            h *= U64(_ROLL)
            h += p[j : j + m]
        h = mix(h + U64(k))
        # Sorting (hash, position) packed into one integer numbers equal k-mers in text order.
        bits = U64(max(1, int(m - 1).bit_length()))
        low = (U64(1) << bits) - U64(1)
        packed = np.sort((h & ~low) | np.arange(m, dtype=U64))
        head, at = packed >> bits, (packed & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
        if len(first) < m:
            run = np.arange(m) - np.repeat(first, np.diff(np.append(first, m)))
            number = np.empty(m, np.int64)
            number[at] = run
            again = number > 0
            h[again] = mix(h[again] + number[again].astype(U64) * U64(0xA0761D6478BD642F))
    return h


def signature(points: np.ndarray, k: int = KMER, sketches: int = SKETCHES, keep: int = KEEP) -> np.ndarray:
    """``sketches`` 32-bit values; all zero for an empty text."""
    h = numbered_kmers(points, k)
    m = len(h)
    out = np.zeros(sketches, np.uint32)
    if m == 0:
        return out
    kept = min(keep, m)
    # The smallest few of m evenly spread values lie below this bound but for bad luck.
    # A multiple of 2**32: what follows the product leaves its high half alone.
    bound = U64(min(int((keep + 12) / m * 2.0**32) + 1, (1 << 32) - 1) << 32) if m > 4 * (keep + 12) else None
    chosen = np.empty((sketches, kept), np.int64)
    step = max(1, _AT_ONCE // m)
    with np.errstate(over="ignore"):
        for j in range(0, sketches, step):
            v = h * _MULTIPLIERS[j : min(j + step, sketches), None]
            n = len(v)
            if bound is not None:
                at = np.flatnonzero(v.ravel() < bound)
                row = at // m
                count = np.bincount(row, minlength=n)
                if count.min() >= keep:
                    x = v.ravel()[at]
                    x ^= x >> U64(32)
                    order = np.lexsort((x, row))
                    best = order[(np.cumsum(count) - count)[:, None] + np.arange(kept)]
                    chosen[j : j + n] = np.sort(at[best] - row[best] * m, axis=1)
                    continue
            v ^= v >> U64(32)
            chosen[j : j + n] = np.sort(np.argsort(v, axis=1, kind="stable")[:, :kept], axis=1)
        t = np.arange(1, sketches + 1, dtype=U64)
        for c in range(chosen.shape[1]):
            t = mix(t * U64(_ROLL) + h[chosen[:, c]])
        out[:] = t >> U64(32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, ghost, doc_id, text) so that each row's follower by descending id comes next.

    Ids are cut into ranges; the first rows of a range are added to the range before
    it as ghosts, and those of the first range to the last one. So every task has what
    it needs and nothing but the ranges' bounds passes through the driver. Null ids
    sort last.
    """
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    # Null ids have the smallest key. Range 0 has the largest ids.
    cuts = ranges.bounds(keyed, "__key", parts)
    keyed = keyed.withColumn("__part", F.lit(len(cuts)) - ranges.number(F.col("__key"), cuts))
    heads = [(r["__part"], r["head"]) for r in keyed.groupBy("__part").agg(F.max("__key").alias("head")).orderBy("__part").collect()]
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}  # the last range for i = 0
    ghosts = docs.sparkSession.createDataFrame([(h, p) for h, p in before.items()], "__head long, __to int")
    joined = keyed.join(F.broadcast(ghosts), F.col("__key") == F.col("__head"), "left")
    places = F.when(F.col("__to").isNull(), F.array(F.struct(F.col("__part").alias("part"), F.lit(False).alias("ghost")))).otherwise(F.array(F.struct(F.col("__part").alias("part"), F.lit(False).alias("ghost")), F.struct(F.col("__to").alias("part"), F.lit(True).alias("ghost"))))
    spread = joined.select(F.explode(places).alias("__at"), "__key", "doc_id", "text").select("__at.part", "__at.ghost", "__key", "doc_id", "text")
    dealt = spread.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ghost", F.desc("__key"), "text")
    return dealt.select("part", "ghost", "doc_id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, k: int = KMER, sketches: int = SKETCHES, keep: int = KEEP) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars/2) code points replaced by the first as
    many (or all) of the next document's by descending doc_id; the last document is
    followed by the first. Null texts are empty; all empty texts have one fingerprint.
    Rows that repeat a doc_id follow each other by text, rows without an id come last.
    A single row is its own next document. Other columns don't take part, and an empty
    table gives an empty result. Long texts are fingerprinted whole.
    """
    parts = ranges.count(docs, parts)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        def rows():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    s = b.slice(at, 256)
                    yield from zip(*(s.column(i).to_pylist() for i in range(4)))

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        last = None  # part, doc_id, text, points, signature of the row that waits for its next
        for part, ghost, doc_id, text in rows():
            if last is not None and last[0] != part:
                last = None
            if ghost and last is None:
                continue
            points = points_of(text)
            sig = signature(points, k, sketches, keep)
            if last is not None:
                _, own_id, own, own_points, own_sig = last
                cut = len(own) // 2
                edited = own[: len(own) - cut] + text[:cut]
                edited_sig = signature(np.concatenate((own_points[: len(own) - cut], points[:cut])), k, sketches, keep) if cut else own_sig
                out.append((own_id, len(own), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_sig.astype(">u4").tobytes().hex(), edited_sig.astype(">u4").tobytes().hex(), likeness(own_sig, edited_sig), likeness(own_sig, sig)))
                if len(out) >= 1000:
                    yield batch()
                    out.clear()
            last = None if ghost else (part, doc_id, text, points, sig)
        if out:
            yield batch()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(with_next(src, parts), run, schema)
