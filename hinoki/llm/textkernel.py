"""Vectorised words and shingles over Arrow string batches.

A word is ``[^\\x20\\x09-\\x0D]+``. Words of a whole batch are located and hashed
at once; nothing runs per character in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .process import process_cache, release

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NONSPACE = ~_SPACE


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(31))
        x = x * U64(0x7FB5D329728EA185)
        x ^= x >> U64(27)
        x *= U64(0x81DADEF4BC2DD44D)
        x ^= x >> U64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; the process keeps the longest table."""
    files = process_cache().files
    have = files.get("powers")
    if have is None or n > len(have[0]):
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(max(n, 1 << 16), U64(base))
            t[0] = 1
            with np.errstate(over="ignore"):
                tables.append(np.multiply.accumulate(t))
        files["powers"] = have = tuple(tables)
    return have[0][:n], have[1][:n]


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows (null: none) and the rows' n+1 offsets into them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n, at = len(col), col.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, at * 8)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def runs(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(begin, length) of runs of rows with about ``most`` bytes of text, a longer text alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < len(col):
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield at, end - at
        at = end


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in such runs of rows by one of its columns; memory is given back after the last."""
    for at, n in runs(batch.column(column), most):
        yield batch.slice(at, n)
    release()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row): byte spans of all words; row r has words row[r] to row[r+1]-1."""
    n = len(data)
    ns = _NONSPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, ns[:-1]
        after[-1], after[:-1] = False, ns[1:]
    start = np.flatnonzero(ns & (~before | edge[:n]))
    end = np.flatnonzero(ns & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offs)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte spans; ``lower`` folds A-Z only."""
    out = np.empty(len(start), U64)
    table, i = (_BYTE_LOWER if lower else _BYTE), 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
            a, b = int(start[i]), int(end[j - 1])
            power, inverse = _powers(b - a + 1)
            sums = np.zeros(b - a + 1, U64)
            np.cumsum(table[data[a:b]] * power[: b - a], out=sums[1:])
            s, e = start[i:j] - a, end[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64)
            i = j
    return mix(out)


def prefixes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial in the values, and the inverse powers that shift a window to 0."""
    power, inverse = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(h * power[:-1], out=sums[1:])
    return sums, inverse


def windows(h: np.ndarray, n: int, pre: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Rolling hash of each run of n consecutive values, over the whole array.

    ``pre`` is ``prefixes(h)``, for several lengths.
    """
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    sums, inverse = pre or prefixes(h)
    with np.errstate(over="ignore"):
        return mix((sums[n:] - sums[:m]) * inverse[:m] + U64(n))


def shingle_sets(col: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct 63-bit hashes of every row's n-word shingles, A-Z lower-cased.

    Fewer than n words: the whole sequence is one shingle. No words: empty.
    """
    data, offs = buffers(col)
    start, end, row = words(data, offs)
    h = span_hashes(data, start, end, lower=True)
    w = windows(h, n) >> U64(1)
    for a, b in zip(row[:-1].tolist(), row[1:].tolist()):
        if b - a >= n:
            s = np.sort(w[a : b - n + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            yield s
        elif b > a:
            yield windows(h[a:b], b - a) >> U64(1)
        else:
            yield h[:0]
