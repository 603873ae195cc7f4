"""Character categories: ranges, masks, runs and word beginnings (code-point offsets)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .batches import bound_batches
from .definitions import CHARACTERS

# Category bits.
BITS = {"DEFAULT": 1, "SPACE": 2, "KANJI": 4, "SYMBOL": 8, "NUMERIC": 16, "ALPHA": 32, "HIRAGANA": 64, "KATAKANA": 128, "KANJINUMERIC": 256, "GREEK": 512, "CYRILLIC": 1024, "USER1": 2048, "USER2": 4096, "USER3": 8192, "USER4": 16384, "NOOOVBOW": 32768}
#: A word can't begin inside a run of these.
GROUPING = BITS["ALPHA"] | BITS["GREEK"] | BITS["CYRILLIC"]


def mask_of_names(names: Iterable[str]) -> int:
    out = 0
    for n in names:
        if n not in BITS:
            raise ValueError(f"unknown category {n}")
        out |= BITS[n]
    return out


def default_ranges() -> list[tuple[int, int, int]]:
    return parse_char_definition(CHARACTERS)[0]


def default_rules() -> dict[str, tuple[bool, bool, int]]:
    return parse_char_definition(CHARACTERS)[1]


def parse_char_definition(lines: Iterable[str]) -> tuple[list[tuple[int, int, int]], dict[str, tuple[bool, bool, int]]]:
    """(ranges, category -> (invoke, group, length)) of a character definition file."""
    ranges, rules = [], {}
    for number, line in enumerate(lines, 1):
        cols = line.split("#", 1)[0].split()
        if not cols:
            continue
        if cols[0].lower().startswith("0x"):
            low, _, high = cols[0].partition("..")
            a, b = int(low, 16), int(high or low, 16)
            if a > b or len(cols) < 2:
                raise ValueError(f"invalid range at line {number}")
            ranges.append((a, b, mask_of_names(cols[1:])))
        else:
            if len(cols) < 4 or cols[0] not in BITS or cols[0] in rules:
                raise ValueError(f"invalid category rule at line {number}")
            rules[cols[0]] = (cols[1] == "1", cols[2] == "1", int(cols[3]))
    return ranges, rules


class Categories:
    """Category mask of a code point: union of the covering ranges, DEFAULT without any."""

    def __init__(self, ranges: Iterable[tuple[int, int, int]] | None = None):
        self.ranges = sorted(default_ranges() if ranges is None else ranges)
        edges = sorted({0, *(a for a, _, _ in self.ranges), *(b + 1 for _, b, _ in self.ranges)})
        masks = [0] * len(edges)
        for a, b, m in self.ranges:
            for i in range(bisect_right(edges, a) - 1, bisect_right(edges, b)):
                masks[i] |= m
        self.edges, self.masks = edges, [m or BITS["DEFAULT"] for m in masks]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    @cached_property
    def table(self) -> np.ndarray:
        """The mask of every code point."""
        return np.repeat(np.array(self.masks, np.uint16), np.diff([*self.edges, max(0x110000, self.edges[-1])]))

    def segments(self) -> list[tuple[int, int, int]]:
        """Disjoint (low, high, mask) over all code points."""
        return [(a, b - 1, m) for a, b, m in zip(self.edges, [*self.edges[1:], 0x110000], self.masks)]

    def mask(self, ch: str) -> int:
        return self.masks[bisect_right(self.edges, ord(ch)) - 1]

    def of(self, text: str) -> np.ndarray:
        """Masks of all code points."""
        return self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)

    def points(self, wanted: Callable[[int], bool]) -> str:
        """The inside of a regular expression's class for the code points whose mask is wanted."""
        return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high, m in self.segments() if wanted(m))


def runs(masks: Sequence[int] | np.ndarray) -> np.ndarray:
    """Length of the run from each position while the intersection of categories lasts.

    A run lasts as long as one category does, so it is the longest of the runs of the
    single categories; each of these ends at the next character without the category.
    """
    masks = np.asarray(masks, np.int64)
    n, at = len(masks), np.arange(len(masks))
    found, ends = np.bitwise_or.reduce(masks, initial=0), at.copy()
    for bit in BITS.values():
        if found & bit:
            # From behind: the next position without the category, or the end.
            np.maximum(ends, np.minimum.accumulate(np.where(masks & bit, n, at)[::-1])[::-1], out=ends)
    return ends - at


def can_begin(masks: Sequence[int] | np.ndarray) -> np.ndarray:
    masks = np.asarray(masks, np.int64)
    out = np.ones(len(masks), bool)
    out[1:] = ((masks[1:] & GROUPING) == 0) | ((masks[1:] & masks[:-1]) == 0)
    return out


def narrowing_runs(text: str, cats: Categories) -> int:
    """Number of runs that a text falls into, each as long as it can be from its first character."""
    length, at, n = runs(cats.of(text)).tolist(), 0, 0
    while at < len(length):
        at, n = at + length[at], n + 1
    return n


# -- the same as Columns ----------------------------------------------------------
def mask_column(ch: Column, cats: Categories | None = None) -> Column:
    """Category mask of a one-character string."""
    cp = F.ascii(ch)
    named = [x for x in (cats or Categories()).segments() if x[2] != BITS["DEFAULT"]]
    if not named:
        return F.lit(BITS["DEFAULT"]).cast("long")
    # One flat CASE; the commonest segment, the small Latin letters, comes first.
    named.sort(key=lambda x: (not x[0] <= 0x61 <= x[1], x[0]))
    out = F.when(cp.between(*named[0][:2]), F.lit(named[0][2]))
    for low, high, m in named[1:]:
        out = out.when(cp.between(low, high), F.lit(m))
    out = out.otherwise(F.lit(BITS["DEFAULT"]))
    return out.cast("long")


def span_mask(masks: Column, begin: Column, length: Column) -> Column:
    """Categories that all characters of a span share; ``begin`` is 0-based."""
    return F.aggregate(F.slice(masks, begin + 1, length), F.lit(-1).cast("long"), lambda a, x: a.bitwiseAND(x))


def begins_column(text: Column, cats: Categories | None = None) -> Column:
    """Number of positions where a word can begin: all but those that go on with a group."""
    cats = cats or Categories()
    grouped = sorted({m for _, _, m in cats.segments() if m & GROUPING})
    if not grouped:
        return F.length(text)
    goes_on = "|".join(f"(?<=[{cats.points(lambda p: p & m)}])[{cats.points(lambda p: p == m)}]" for m in grouped)  # noqa: B023
    return F.length(text) - F.regexp_count(text, F.lit(goes_on))


def runs_column(text: Column, cats: Categories | None = None) -> Column:
    """Number of narrowing runs, by an Arrow UDF; null for null."""
    own = cats or Categories()

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else narrowing_runs(x, own)).astype("Int64")

    bound_batches(SparkSession.active())
    return run(text)
