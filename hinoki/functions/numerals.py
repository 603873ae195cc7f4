"""Numerals as strings of any precision: digits, kanji digits, 十百千, 万億兆, points and commas.

A numeral is a row of sections that end in 万, 億 or 兆, the last one without. A section
is a row of terms that end in 十, 百 or 千, the last one without. A term is a plain
number, or nothing (one ten, one hundred...). Values are decimal places: a string of
digits and the power of ten of its last digit. What follows must fit into the places
that a value leaves free, so adding is writing one string behind the other.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DIGITS = {c: d for row in ("0123456789", "〇一二三四五六七八九") for d, c in enumerate(row)}
SMALL = {"十": 1, "百": 2, "千": 3}
LARGE = {"万": 4, "億": 8, "兆": 12}

_ASCII = str.maketrans({c: str(d) for c, d in DIGITS.items()})
_TERM = re.compile(f"([0-9.,]*)([{''.join(SMALL)}{''.join(LARGE)}]|$)")
_PLAIN = re.compile(r"([0-9]+)(?:\.([0-9]+))?")
_GROUPED = re.compile(r"(?!0+,)([0-9]{1,3}(?:,[0-9]{3})+)(?:\.([0-9]+))?")
#: Groups that a further comma may follow.
_GROUPS = re.compile(r"(?!0+,)[0-9]{1,3}(?:,[0-9]{3})*")
_MARK = re.compile("[.,]")


class Places(NamedTuple):
    """``digits`` times ten to the power of ``low``."""

    digits: str
    low: int

    def then(self, other: Places | None) -> Places | None:
        """Both as one, or None if ``other`` needs a place that is taken."""
        if other is None:
            return self
        free = self.low - other.low - len(other.digits)
        return None if free < 0 else Places(self.digits + "0" * free + other.digits, other.low)

    def times(self, power: int) -> Places:
        return Places(self.digits, self.low + power)

    def __str__(self) -> str:
        if self.low >= 0:
            return self.digits + "0" * self.low
        fraction = self.digits[self.low :].rstrip("0")
        return self.digits[: self.low] + ("." + fraction if fraction else "")


class Parsed(NamedTuple):
    """``error`` is NONE, POINT, COMMA or OTHER; ``at`` is where it shows, the length at the end."""

    accepted: bool
    normalized: str | None
    error: str
    at: int


def _mark_error(term: str) -> tuple[str, int] | None:
    """The first comma or point of a term that what stands before it doesn't allow."""
    head, point, fraction = term.partition(".")
    comma = head.find(",")
    if comma >= 0:
        whole = _GROUPS.match(head)
        end = whole.end() if whole else -1
        # The comma after whole groups may stand; the next one closes a group that isn't whole.
        bad = head.find(",", end + 1) if end >= comma else comma
        if bad >= 0:
            return "COMMA", bad
        if point and end < len(head):
            return "COMMA", len(head)
    elif point and not head:
        return "POINT", 0
    second = _MARK.search(fraction)
    return second and ("COMMA" if second[0] == "," else "POINT", len(head) + 1 + second.start())


def _number(term: str) -> Places | str:
    """A plain number, or the rule that its end breaks."""
    m = _PLAIN.fullmatch(term) or _GROUPED.fullmatch(term)
    if m is None:
        return "POINT" if term.endswith(".") else "COMMA"
    fraction = m[2] or ""
    return Places(m[1].replace(",", "") + fraction, -len(fraction))


def read(text: str) -> Parsed:
    """The value of a whole text."""
    plain, at = text.translate(_ASCII), 0
    total: Places | None = None
    section: Places | None = None
    failed = lambda error, place: Parsed(False, None, error, place)
    while True:
        m = _TERM.match(plain, at)
        term = m[1] if m else re.compile("[0-9.,]*").match(plain, at)[0]
        if bad := _mark_error(term):
            return failed(bad[0], at + bad[1])
        at += len(term)
        if m is None:
            return failed("OTHER", at)
        value = _number(term) if term else None
        if isinstance(value, str):
            return failed(value, at)
        unit = m[2]
        if unit in SMALL:
            value = (value or Places("1", 0)).times(SMALL[unit])
        section = value if section is None else section.then(value)
        if section is None and (value is not None or unit in LARGE):
            return failed("OTHER", at)
        if unit in SMALL:
            at += 1
            continue
        if section is not None:
            section = section.times(LARGE.get(unit, 0))
            total = section if total is None else total.then(section)
            if total is None:
                return failed("OTHER", at)
        section = None
        if not unit:
            return Parsed(True, str(total), "NONE", at) if total else failed("OTHER", at)
        at += 1


def parse(text: str) -> tuple[bool, str | None, str]:
    """(accepted, normalized, error)."""
    return read(text)[:3]


def numeral_column(text: Column) -> Column:
    """struct(ok, normalized, error) by an Arrow UDF."""

    @F.pandas_udf("ok boolean, normalized string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x or "") for x in s], columns=["ok", "normalized", "error"])

    return run(text)
