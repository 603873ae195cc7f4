"""Sentence boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice, repeat

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PERIODS, DOTS, COMMAS = "。？！♪…?!", ".．", ",，、"
OPEN, CLOSE = '({｛[（「【『［≪〔"', ')}]）」｝】』］〕≫"'
ALNUM = "a-zA-Z0-9ａ-ｚＡ-Ｚ０-９〇一二三四五六七八九十百千万億兆"
LIMIT = 4096

_close, _open, _period = re.escape(CLOSE), re.escape(OPEN), re.escape(PERIODS)
BREAKER = re.compile(f"[{_period}]|・{{3,}}|(?<![{ALNUM}])[{DOTS}](?![{ALNUM}{COMMAS}])[{DOTS}{_period}]*|(?:<br>|<BR>){{2,}}")
PROHIBITED = re.compile(f"[{_close}{COMMAS}{_period}]+")
ITEM = re.compile(f"[{ALNUM}][{DOTS}]")
ITEM_END = re.compile(f"[{ALNUM}][{DOTS}]$")
QUOTE = re.compile(f"[！？!?{_close}](?:と|っ|です)")
HEAD = re.compile(r".+\s+")
PAREN = re.compile(f"[{re.escape(OPEN + CLOSE)}]")


def _levels(text: str) -> Iterator[int]:
    level, quoted = 0, False
    for c in text:
        if c == '"':
            level, quoted = max(0, level + (-1 if quoted else 1)), not quoted
        elif c in OPEN:
            level += 1
        elif c in CLOSE:
            level = max(0, level - 1)
        yield level


def paren_level(text: str) -> int:
    """Openers less closers, never below 0; a straight double quote toggles."""
    level = 0
    for level in _levels(text):
        pass
    return level


def _continues(text: str, eos: int) -> bool:
    """Whether the first quote marker of the text is at the boundary, or an item's number goes on."""
    if QUOTE.match(text, eos - 1) and QUOTE.search(text).start() == eos - 1:
        return True
    return text[eos] in "とやの" and ITEM_END.search(text, max(0, eos - 2), eos) is not None


def find_eos(text: str, veto: Callable[[str, int], bool] | None = None, limit: int = LIMIT) -> int:
    """> 0: a boundary; < 0: no boundary, cut after so many characters if need be; 0: empty text."""
    if not text:
        return 0
    window = text[:limit]
    at, levels, more = 0, [], None
    while m := BREAKER.search(window, at):
        end = at = m.end()
        if p := PROHIBITED.match(window, end):
            end = p.end()
        if more is None and PAREN.search(window, len(levels), end):
            levels, more = [], _levels(window)
        if more is None:
            levels += repeat(0, end - len(levels))
        else:
            levels += islice(more, end - len(levels))
        if levels[end - 1]:
            continue
        if ITEM.fullmatch(window, 0, m.end()):
            continue
        if end < len(window) and _continues(window, end):
            continue
        if veto is not None and veto(text, end):
            continue
        return end
    if len(text) > limit and (m := HEAD.match(window)):
        return -m.end()
    return -len(window)


def split(text: str, veto: Callable[[str, int], bool] | None = None, limit: int = LIMIT) -> Iterator[tuple[int, int]]:
    """(begin, end) of each sentence; white space between sentences is skipped, nothing else."""
    at = 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return
        n = abs(find_eos(text[at:] if len(text) - at <= 2 * limit else text[at : at + 2 * limit], veto, limit))
        yield at, at + n
        at += n


# -- native forms ---------------------------------------------------------------
def paren_level_column(text: Column) -> Column:
    """As ``paren_level`` for texts without straight double quotes."""
    one = lambda c: F.when(c.isin(*OPEN[:-1]), 1).when(c.isin(*CLOSE[:-1]), -1).otherwise(0)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.greatest(a + one(c), F.lit(0)))


def prohibited_column(text: Column) -> Column:
    """Length of the leading run of characters that can't begin a sentence."""
    inner = "".join(f"\\x{{{ord(c):x}}}" for c in CLOSE + COMMAS + PERIODS)
    return F.length(F.regexp_extract(text, f"^([{inner}]*)", 1))
