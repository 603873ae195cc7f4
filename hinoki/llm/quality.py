"""Quality rules by repetition coverage (operator 8).

Rolling hashes of several n-gram lengths measure the share of a text's word
characters that lie inside duplicated n-grams, and inside duplicated lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .process import bound_batches, release
from .textkernel import buffers, prefixes, runs, span_hashes, windows, words

#: n-gram length -> largest share of word characters inside duplicated n-grams.
COVERAGE = {5: 0.30, 6: 0.28, 8: 0.25, 10: 0.22}
#: Largest share of word characters inside lines that repeat an earlier line.
LINE_COVERAGE = 0.30
#: Largest number of symbol characters for each word.
SYMBOLS_PER_WORD = 0.10

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_coverage double, ngram_coverage array<double>, base_failed boolean, kept boolean"


def repeated(h: np.ndarray) -> np.ndarray:
    """Mask of the values that occur twice or more."""
    out = np.zeros(len(h), bool)
    if len(h) > 1:
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        out[order] = twice
    return out


def later_copies(h: np.ndarray) -> np.ndarray:
    """Mask of the values that occur earlier in the array too."""
    out = np.zeros(len(h), bool)
    if len(h) > 1:
        order = np.argsort(h, kind="stable")
        s = h[order]
        out[order[1:]] = s[1:] == s[:-1]
    return out


def covered(dup: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the words inside a duplicated n-word window."""
    step = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(dup)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:total]) > 0


def measure(col: pa.Array, coverage: dict[int, float], line_limit: float, symbol_limit: float) -> dict[str, list]:
    data, offs = buffers(col)
    start, end, row = words(data, offs)
    h = span_hashes(data, start, end, lower=False)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    chars = points[end] - points[start]
    pre = prefixes(h)
    grams = {n: windows(h, n, pre) for n in {5, *coverage}}
    breaks = np.flatnonzero(data == 10)
    out: dict[str, list] = {k.split()[0]: [] for k in MEASURES.split(", ")}
    for r in range(len(offs) - 1):
        lo, hi, a, b = int(offs[r]), int(offs[r + 1]), int(row[r]), int(row[r + 1])
        n, c = b - a, chars[a:b]
        total = int(c.sum())
        shares, repeat5 = [], 0
        for k in grams:
            mask = covered(repeated(grams[k][a : b - k + 1]), k, n) if n > k else None
            if k == 5:
                repeat5 = 0 if mask is None else int(mask.sum())
            if k in coverage:
                shares.append(0.0 if mask is None or not total else float(c[mask].sum()) / total)
        cut = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, hi)]
        dup_lines, dup_chars = 0, 0
        if len(cut):
            ls, le = np.concatenate(([lo], cut + 1)), np.concatenate((cut, [hi]))
            first, last = np.searchsorted(start, ls), np.searchsorted(start, le)
            full = last > first
            ls, le, first, last = ls[full], le[full], first[full], last[full]
            dup = later_copies(span_hashes(data, ls, le, lower=False))
            sums = np.concatenate(([0], np.cumsum(c)))
            dup_lines = int(dup.sum())
            dup_chars = int((sums[last - a] - sums[first - a])[dup].sum())
        n_symbols = int(symbols[hi] - symbols[lo])
        base = n < 10 or 100 * repeat5 > 20 * n
        lines = dup_chars / total if total else 0.0
        good = lines <= line_limit and n_symbols <= symbol_limit * n and all(s <= coverage[k] for s, k in zip(shares, (k for k in grams if k in coverage)))
        for k, v in zip(out, (n, total, n_symbols, dup_lines, repeat5, lines, shares, base, bool(not base and good))):
            out[k].append(v)
    return out


def quality(docs: DataFrame, text_col: str = "text", coverage: dict[int, float] | None = None, line_limit: float = LINE_COVERAGE, symbol_limit: float = SYMBOLS_PER_WORD, prefix: str = "") -> DataFrame:
    """All rows and columns of ``docs`` with the measures of the text, in one narrow pass.

    A null or empty text, or one without words, has zero measures and fails the
    base rule. Texts of any length are measured whole. Ties don't arise; repeated
    rows are judged alike, each on its own. An input column named like a measure
    is replaced (names compare without case); give ``prefix`` to keep both.
    """
    bound_batches(docs.sparkSession)
    fields = T.StructType.fromDDL(MEASURES).fields
    taken = {f"{prefix}{f.name}".lower() for f in fields}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    judged = docs.select(*kept, measures(F.col(f"`{text_col}`"), coverage, line_limit, symbol_limit).alias("__measures"))
    return judged.select(*kept, *[F.col(f"__measures.{f.name}").alias(f"{prefix}{f.name}") for f in fields])


def measures(text: Column, coverage: dict[int, float] | None, line_limit: float, symbol_limit: float) -> Column:
    """The measures as one struct. Only the text goes to Python; other columns stay in the JVM."""
    coverage = COVERAGE if coverage is None else coverage

    @F.arrow_udf(T.StructType.fromDDL(MEASURES))
    def run(col: pa.Array) -> pa.Array:
        types = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.bool_()]
        made: dict[str, list] = {x.split()[0]: [] for x in MEASURES.split(", ")}
        for at, n in runs(col):
            for name, values in measure(col.slice(at, n), coverage, line_limit, symbol_limit).items():
                made[name] += values
        out = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(made.values(), types)], names=list(made))
        release()
        return out

    return run(text)


def keep_good(docs: DataFrame, text_col: str = "text", coverage: dict[int, float] | None = None, line_limit: float = LINE_COVERAGE, symbol_limit: float = SYMBOLS_PER_WORD) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they came with."""
    bound_batches(docs.sparkSession)
    return docs.filter(measures(F.col(f"`{text_col}`"), coverage, line_limit, symbol_limit)["kept"])
