"""Text normalization with maps from normalized to original offsets (code points)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.plugins import InputText
from .batches import bound_batches
from .charclass import BITS, Categories
from .definitions import kept_characters, voiced_kana

SURROGATE = re.compile("[\ud800-\udfff]")
PROLONGED = "ー-⁓〜〰"
OPEN_BRACKETS, CLOSE_BRACKETS = "(（", ")）"


@dataclass
class Edited:
    """A text being rewritten; ``origin[i]`` is the original offset of character i, its last item the end."""

    original: str
    text: str = ""
    origin: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.text = self.original
        self.origin = list(range(len(self.original) + 1))

    def substring(self, begin: int, end: int) -> str:
        """The present text from begin to end, both of which must lie in it."""
        if not 0 <= begin <= end <= len(self.text):
            raise IndexError("range is outside of the text")
        return self.text[begin:end]

    def part(self, begin: int, end: int) -> Edited:
        """A slice of the present text, with its offsets in the whole original."""
        out = object.__new__(Edited)  # without the offsets of the whole
        out.original, out.text, out.origin = self.original, self.text[begin:end], self.origin[begin : end + 1]
        return out

    def replace_all(self, spans: Iterable[tuple[int, int, str]]) -> None:
        """``replace`` for ascending spans (begin, end, new) of the present text that don't overlap, in one pass."""
        text, origin, at = [], [], 0
        for begin, end, new in spans:
            text += self.text[at:begin], new
            origin += self.origin[at:begin]
            if new:
                origin.append(self.origin[begin])
                origin += [self.origin[end]] * (len(new) - 1)
            at = end
        self.text = "".join((*text, self.text[at:]))
        self.origin = origin + self.origin[at:]

    def replace(self, begin: int, end: int, new: str) -> None:
        """The first new character keeps the origin of ``begin``, later ones get that of ``end``."""
        if begin < 0 or begin > len(self.text):
            raise IndexError("begin is out of range")
        if begin > end:
            raise IndexError("begin is after end")
        if begin == end:
            raise ValueError("empty range")
        end = min(end, len(self.text))
        self.text = self.text[:begin] + new + self.text[end:]
        self.origin[begin:end] = [self.origin[begin] if i == 0 else self.origin[end] for i in range(len(new))]


@dataclass
class DefaultRewrite(InputText):
    """Longest replacement first; else lower case, then NFKC of the single character unless ignored."""

    ignore: frozenset[str] = frozenset()
    replacements: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_lines(cls, lines: Iterable[str]) -> DefaultRewrite:
        ignore, pairs = set(), {}
        for number, line in enumerate(lines, 1):
            cols = line.split()
            if not cols or cols[0].startswith("#"):
                continue
            if len(cols) == 1 and len(cols[0]) == 1:
                ignore.add(cols[0])
            elif len(cols) == 2 and cols[0] not in pairs:
                pairs[cols[0]] = cols[1]
            else:
                raise ValueError(f"invalid rewrite rule at line {number}")
        return cls(frozenset(ignore), pairs)

    @classmethod
    def standard(cls) -> DefaultRewrite:
        """The packaged rules."""
        return cls(kept_characters(), voiced_kana())

    def __post_init__(self):
        keys = sorted(self.replacements, key=len, reverse=True)
        self._keys = re.compile("|".join(map(re.escape, keys))) if keys else None
        self._single = _Single(self.ignore)

    def rewrite(self, t: Edited) -> None:
        text = t.text
        found = list(self._keys.finditer(text)) if self._keys else []
        if not found:
            new = text.translate(self._single)
            if len(new) == len(text):  # a character never becomes nothing, so each has become one
                t.text = new
                return
        t.replace_all(self._spans(text, found))

    def _spans(self, text: str, found: list[re.Match]) -> Iterator[tuple[int, int, str]]:
        at = 0
        for m in (*found, None):
            for i in range(at, m.start() if m else len(text)):
                new = self._single[ord(text[i])]
                if new != text[i]:
                    yield i, i + 1, new
            if m:
                yield m.start(), m.end(), self.replacements[m[0]]
                at = m.end()


class _Single(dict):
    """Code point -> what a single character becomes, found out once."""

    def __init__(self, ignore: frozenset[str]):
        self.ignore = ignore

    def __missing__(self, point: int) -> str:
        low = chr(point).lower()
        self[point] = new = low if low in self.ignore else unicodedata.normalize("NFKC", low)
        return new

    def __reduce__(self):
        return _Single, (self.ignore,)


@dataclass
class ProlongedMarks(InputText):
    """Two or more marks of the set become one symbol."""

    marks: str = PROLONGED
    symbol: str = "ー"

    def rewrite(self, t: Edited) -> None:
        t.replace_all((m.start(), m.end(), self.symbol) for m in re.finditer(f"[{re.escape(self.marks)}]{{2,}}", t.text))


@dataclass
class StripRuby(InputText):
    """Drops a bracketed kana reading of at most ``longest`` characters after a kanji."""

    longest: int = 4
    categories: Categories = field(default_factory=Categories)

    def rewrite(self, t: Edited) -> None:
        kana = BITS["HIRAGANA"] | BITS["KATAKANA"]
        pattern = f"[{OPEN_BRACKETS}]([^{OPEN_BRACKETS}{CLOSE_BRACKETS}]{{1,{self.longest}}})[{CLOSE_BRACKETS}]"

        def ruby(m: re.Match) -> bool:
            before = t.text[m.start() - 1 : m.start()]
            return bool(before and self.categories.mask(before) & BITS["KANJI"]) and all(self.categories.mask(c) & kana for c in m[1])

        t.replace_all((m.start(), m.end(), "") for m in re.finditer(pattern, t.text) if ruby(m))


def valid_column(text: Column) -> Column:
    """Whether a text is well-formed, so without half of a surrogate pair."""
    return F.is_valid_utf8(text)


def normalized(text: str, chain: Sequence) -> Edited:
    """The text after all plugins of the chain; half of a surrogate pair is an error."""
    if not text.isascii() and SURROGATE.search(text):
        raise ValueError("lone surrogate in the text")
    t = Edited(text)
    for plugin in chain:
        plugin.rewrite(t)
    return t


def normalize_column(text: Column, chain: Sequence, native_ascii: bool = False) -> Column:
    """Normalized text by an Arrow UDF; null stays null.

    With ``native_ascii`` ASCII texts are only lower-cased, without leaving the JVM: that
    is what the default rewriting does to them.
    """

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else normalized(x, chain).text)

    bound_batches(SparkSession.active())
    if not native_ascii:
        return run(text)
    plain = text.rlike(r"\A[\x00-\x7F]*\z")
    # The UDF runs over every row whatever the branch, so ASCII texts go there as nulls.
    return F.when(plain, F.lower(text)).otherwise(run(F.when(~plain, text)))


# -- native forms ---------------------------------------------------------------
def collapse_marks(text: Column, marks: str = PROLONGED, symbol: str = "ー") -> Column:
    inner = "".join(f"\\x{{{ord(c):x}}}" for c in marks)
    return F.regexp_replace(text, f"[{inner}]{{2,}}", symbol)


def strip_ruby(text: Column, longest: int = 4) -> Column:
    return F.regexp_replace(text, rf"([\x{{3005}}\x{{3007}}\x{{3400}}-\x{{4DB5}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FA2D}}])[(（][\x{{3041}}-\x{{309F}}\x{{30A1}}-\x{{30FA}}\x{{30FC}}-\x{{30FF}}]{{1,{longest}}}[)）]", "$1")
