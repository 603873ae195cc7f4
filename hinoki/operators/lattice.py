"""Lattice building, best path and path rewriting for one text (code-point offsets)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import accumulate, repeat

import numpy as np

from ..functions import counters, numerals
from ..functions.charclass import BITS, Categories, can_begin, runs
from ..plans.dictionary import INHIBITED, Compiled, Word
from .plugins import OovProvider, PathRewrite

_NUMERIC, _NO_OOV = BITS["NUMERIC"] | BITS["KANJINUMERIC"], BITS["NOOOVBOW"]


@dataclass(slots=True)
class Node:
    begin: int
    end: int
    word: Word
    is_oov: bool = False
    total: int | None = None
    best: Node | None = field(default=None, repr=False)


class Chars:
    """A normalized text with its category masks, runs and word beginnings; what not every text needs is made when asked for."""

    def __init__(self, text: str, cats: Categories):
        self.text, self.mask_array = text, cats.of(text)
        self.begin_array = can_begin(self.mask_array)
        self.start_array = np.flatnonzero(self.begin_array)
        self.starts: list[int] = self.start_array.tolist()

    @classmethod
    def of(cls, text: str, cats: Categories) -> Chars:
        return cls(text, cats)

    @cached_property
    def masks(self) -> list[int]:
        return self.mask_array.tolist()

    @cached_property
    def run_array(self) -> np.ndarray:
        return runs(self.mask_array)

    @cached_property
    def runs(self) -> list[int]:
        return self.run_array.tolist()

    @cached_property
    def begins(self) -> list[bool]:
        return self.begin_array.tolist()

    @cached_property
    def nexts(self) -> list[int]:
        """A position's next word beginning, or the end."""
        return np.append(self.start_array, len(self.text))[np.cumsum(self.begin_array)].tolist()

    def candidate(self, at: int) -> int:
        """Length up to the next position where a word can begin."""
        return self.nexts[at] - at

    def has(self, mask: int) -> bool:
        """Whether any character is of these categories."""
        return bool((self.mask_array & mask).any())


def oov_word(surface: str, left: int, right: int, cost: int, pos_id: int) -> Word:
    return Word(-1, -1, left, right, cost, surface, len(surface), pos_id, "", surface, surface)


class _Words(dict):
    """Surface -> unknown word of one kind, remembered within bounds."""

    MOST, LONGEST = 1 << 16, 64

    def __init__(self, *kind: int):
        self.kind = kind

    def __missing__(self, surface: str) -> Word:
        word = oov_word(surface, *self.kind)
        if len(surface) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[surface] = word
        return word

    def __reduce__(self):
        return _Words, self.kind


# -- out-of-vocabulary providers: (chars, offset, lengths seen) -> nodes ---------------
@dataclass
class SimpleOov(OovProvider):
    pos: Sequence[str]
    left_id: int = 0
    right_id: int = 0
    cost: int = 30000
    register: bool = False

    def set_up(self, d: Compiled) -> None:
        self.pos_id = d.pos_id(self.pos, self.register)
        self.words = _Words(self.left_id, self.right_id, self.cost, self.pos_id)

    def provide(self, c: Chars, at: int, seen: set[int]) -> list[Node]:
        if seen:
            return []
        end = c.nexts[at]
        return [Node(at, end, self.words[c.text[at:end]], True)]


@dataclass
class CategoryOov(OovProvider):
    """Runs and prefixes of a character category, by rule."""

    categories: dict[str, tuple[bool, bool, int]]
    rules: Sequence[tuple[str, int, int, int, Sequence[str]]]
    register: bool = False

    def set_up(self, d: Compiled) -> None:
        self.by_mask = []
        rows, cols = d.matrix.shape
        for cat, left, right, _, _ in self.rules:
            if cat not in self.categories:
                raise ValueError(f"unknown-word rule for category {cat}, which has no category rule")
            if not (0 <= left < cols and 0 <= right < rows):
                raise ValueError(f"unknown-word rule for {cat} names ids outside of the matrix")
        for name, (invoke, group, length) in self.categories.items():
            own = [_Words(left, right, cost, d.pos_id(pos, self.register)) for cat, left, right, cost, pos in self.rules if cat == name]
            self.by_mask.append((BITS[name], invoke, group, length, own))
        self.fitting: dict[tuple[int, bool], list] = {}

    def _fits(self, mask: int, seen: bool) -> list[tuple[bool, int, list[_Words]]]:
        """(group, length, words of the rules) of the categories in a mask."""
        found = self.fitting.get((mask, seen))
        if found is None:
            found = self.fitting[mask, seen] = [x[2:] for x in self.by_mask if mask & x[0] and (x[1] or not seen)]
        return found

    def provide(self, c: Chars, at: int, seen: set[int]) -> list[Node]:
        out, run = [], c.runs[at]
        for group, length, rules in self._fits(c.masks[at], bool(seen)):
            limit, lengths = run, []
            if group:
                lengths.append(run)
                limit -= 1
            lengths += range(1, min(length, limit) + 1)
            for n in lengths:
                s = c.text[at : at + n]
                out += [Node(at, at + n, words[s], True) for words in rules]
        return out

    def spans(self, c: Chars) -> list[tuple[_Words, np.ndarray, np.ndarray]]:
        """(words of a rule, begins, ends) of all that ``provide`` has at the word beginnings with nothing seen there."""
        out, masks, run = [], c.mask_array[c.start_array], c.run_array[c.start_array]
        for mask in np.unique(masks).tolist():
            own = masks == mask
            at, most = c.start_array[own], run[own]
            for group, length, rules in self._fits(mask, False):
                found, limit = [], most - 1 if group else most
                if group:
                    found.append((at, at + most))
                for n in range(1, min(length, int(limit.max())) + 1):
                    fits = at[limit >= n]
                    found.append((fits, fits + n))
                begins, ends = map(np.concatenate, zip(*found)) if found else (at[:0], at[:0])
                out += [(words, begins, ends) for words in rules]
        return out


@dataclass
class RegexOov(OovProvider):
    regex: str
    pos: Sequence[str]
    left_id: int = 0
    right_id: int = 0
    cost: int = 0
    longest: int = 32
    strict: bool = True
    register: bool = False

    def set_up(self, d: Compiled) -> None:
        if max(abs(self.left_id), abs(self.right_id), abs(self.cost)) > 32767:
            raise ValueError("ids and cost must be at most 32767")
        self.pattern, self.pos_id = re.compile(self.regex), d.pos_id(self.pos, self.register)
        self.words = _Words(self.left_id, self.right_id, self.cost, self.pos_id)

    def idle(self, c: Chars) -> np.ndarray | None:
        """Every beginning is tried as ``provide`` does it: a pattern may look at the end that the length sets."""
        if type(self).provide is not RegexOov.provide:
            return None
        at = c.start_array
        if self.strict:
            at = at[(at == 0) | ((c.mask_array[at] & c.mask_array[at - 1]) == 0)]
        begins, stops = at.tolist(), (at + self.longest).tolist()
        found = zip(begins, map(self.pattern.match, repeat(c.text), begins, stops))
        out = np.ones(len(c.text), bool)
        out[[i for i, m in found if m and m.end() > i]] = False
        return out

    def provide(self, c: Chars, at: int, seen: set[int]) -> list[Node]:
        if self.strict and at and c.masks[at] & c.masks[at - 1]:
            return []
        m = self.pattern.match(c.text, at, min(len(c.text), at + self.longest))
        if not m or m.end() == at or m.end() - at in seen:
            return []
        return [Node(at, m.end(), self.words[m[0]], True)]


COUNTER_POS = ("接尾辞", "名詞的")
# What a number ends in.
_NUMBER_END = frozenset("0123456789０１２３４５６７８９〇一二三四五六七八九十百千万億兆")


@dataclass
class CounterOov(OovProvider):
    """Kana spellings of counters directly after a number, with the counter's own attributes."""

    counters: dict[str, Sequence[str]] = field(default_factory=lambda: {c.surface: c.spellings for c in counters.COUNTERS})

    def set_up(self, d: Compiled) -> None:
        self.aliases: dict[str, list[Word]] = {}
        for counter, kana in self.counters.items():
            own = [w for w in d.index.get(counter, ()) if d.pos[w.pos_id][:2] == COUNTER_POS]
            for alias in kana if own else ():
                w = own[0]
                if not any(x.pos_id == w.pos_id and x.normalized == w.normalized for x in d.index.get(alias, ())):
                    reading = "".join(chr(ord(k) + 0x60) for k in alias)
                    self.aliases.setdefault(alias, []).append(replace(w, dict_id=-1, word_id=-1, surface=alias, length=len(alias), reading=reading, a_split=(), b_split=(), synonyms=()))
        self.longest = max(map(len, self.aliases), default=0)
        self.number_end = re.compile(f"[{''.join(sorted(_NUMBER_END))}]")

    def idle(self, c: Chars) -> np.ndarray:
        out = np.ones(len(c.text) + 1, bool)
        if self.aliases:
            out[[m.end() for m in self.number_end.finditer(c.text)]] = False
        return out[:-1]

    def provide(self, c: Chars, at: int, seen: set[int]) -> list[Node]:
        if not at or not self.aliases or c.text[at - 1] not in _NUMBER_END:
            return []
        found = [(n, w) for n in range(min(self.longest, len(c.text) - at), 0, -1) for w in self.aliases.get(c.text[at : at + n], ())]
        return [Node(at, at + n, w, True) for n, w in found]


# -- lattice and best path -----------------------------------------------------------
class Chain(Sequence):
    """Unknown words one after the other, each with one node before it; their nodes are made when asked for."""

    def __init__(self, text: str, words: _Words, begins: list[int], ends: list[int], totals: Iterable[int], before: Node):
        self.text, self.words, self.begins, self.ends, self.totals, self.before = text, words, begins, ends, totals, before

    @cached_property
    def nodes(self) -> list[Node]:
        text, words, best = self.text, self.words, self.before
        nodes = [Node(a, b, words[text[a:b]], True, t) for a, b, t in zip(self.begins, self.ends, self.totals)]
        for n in nodes:
            n.best = best
            best = n
        return nodes

    def surfaces(self) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(self.begins, self.ends)]

    def __len__(self) -> int:
        return len(self.begins)

    def __getitem__(self, at):
        return self.nodes[at]

    def __iter__(self):
        return iter(self.nodes)


def begins(path: Sequence[Node]) -> list[int]:
    return path.begins if isinstance(path, Chain) else [n.begin for n in path]


def ends(path: Sequence[Node]) -> list[int]:
    return path.ends if isinstance(path, Chain) else [n.end for n in path]


class Lattice:
    def __init__(self, d: Compiled, size: int):
        bos = Word(-1, -1, 0, 0, 0, "", 0, -1, "", "", "")
        self.d, self.size = d, size
        self.bos = Node(0, 0, bos, total=0)
        self._ends: dict[int, list[Node]] = {0: [self.bos]}
        #: The chain that is the whole text, if there is one, and the total at its end.
        self.whole: tuple[Chain, int] | None = None

    @property
    def ends(self) -> dict[int, list[Node]]:
        if self.whole and len(self._ends) == 1:
            self.add(self.whole[0])
        return self._ends

    def add(self, chain: Chain) -> None:
        """Insert the nodes of a chain, which no other node spans."""
        self._ends.update(zip(chain.ends, zip(chain.nodes)))
        self._ends[chain.ends[-1]] = [chain.nodes[-1]]

    def insert(self, n: Node) -> None:
        n.total, n.best = self._best(n.begin, n.word.left_id, n.word.cost)
        if n.end in self.ends:
            self.ends[n.end].append(n)
        else:
            self.ends[n.end] = [n]

    def _best(self, at: int, left_id: int, cost: int) -> tuple[int | None, Node | None]:
        best, low, connect = None, None, self.d.connect
        for p in self.ends.get(at, ()):
            if p.total is None:
                continue
            edge = connect(p.word.right_id, left_id)
            if edge != INHIBITED and (low is None or p.total + edge < low):
                best, low = p, p.total + edge
        return (None if best is None else low + cost), best

    def nodes(self) -> list[Node]:
        return [n for at in sorted(self.ends) for n in self.ends[at] if n is not self.bos]

    def spanning(self, begin: int, end: int) -> list[Node]:
        return [n for n in self.ends.get(end, ()) if n.begin == begin and n is not self.bos]

    def cheapest(self, begin: int, end: int, wanted=lambda n: True) -> Node | None:
        hits = [n for n in self.spanning(begin, end) if n.total is not None and wanted(n)]
        return min(hits, key=lambda n: n.total, default=None)

    def path(self) -> Sequence[Node]:
        if self.whole:
            chain, total = self.whole
            edge = self.d.connect(chain.words.kind[1], 0)
            if edge == INHIBITED:
                raise ValueError("end of text is not reachable")
            self.total = total + edge
            return chain
        total, last = self._best(self.size, 0, 0)
        if last is None:
            raise ValueError("end of text is not reachable")
        self.total = total
        out = []
        while last is not self.bos:
            out.append(last)
            last = last.best
        return out[::-1]


def build(d: Compiled, c: Chars, oov: Sequence) -> Lattice:
    lat, size = Lattice(d, len(c.text)), len(c.text)
    # Beginnings from ``at`` on to ``stops``, where there is but one unknown word each.
    stops = _lone(d, c, oov)
    i, starts, ends, reach = 0, c.starts, lat.ends, 0
    begins, masks = (c.begins, c.masks) if stops is None else (c.begin_array, c.mask_array)
    while i < len(starts):
        at = starts[i]
        if at not in ends:
            i += 1
            continue
        if stops is not None and stops[i] - i > 1 and at >= reach:
            n = _chain(lat, c, oov[-1], i, stops[i])
            if n:
                i, reach = stops[i], n
                continue
        seen: set[int] = set()
        for w in d.prefixes(c.text, at):
            end = at + w.length
            if end == size or begins[end]:
                lat.insert(Node(at, end, w))
                seen.add(w.length)
        if not masks[at] & _NO_OOV:
            for p in oov:
                for n in p.provide(c, at, seen):
                    lat.insert(n)
                    seen.add(n.end - n.begin)
        if not seen and oov:
            for n in oov[-1].provide(c, at, seen):
                lat.insert(n)
                seen.add(n.end - n.begin)
        if not seen:
            raise ValueError(f"no candidate at {at}")
        reach, i = max(reach, at + max(seen)), i + 1
    return lat


def _lone(d: Compiled, c: Chars, oov: Sequence) -> list[int] | None:
    """For each beginning the next one where the lexicon or another provider than the last may have words.

    None if a provider doesn't say where it is idle, or the last one isn't a plain SimpleOov.
    """
    if not oov or type(oov[-1]) is not SimpleOov:
        return None
    lone = ~d.may_begin(c.text)
    for p in oov[:-1]:
        idle = p.idle(c)
        if idle is None:
            return None
        lone &= idle
    lone = lone[c.start_array]
    busy = np.append(np.flatnonzero(~lone), len(lone))
    return np.where(lone, busy[np.searchsorted(busy, np.arange(len(lone)))], 0).tolist()


def _chain(lat: Lattice, c: Chars, simple: SimpleOov, i: int, stop: int) -> int:
    """Insert the lone nodes of beginnings i to stop, which no other node spans, and return their end.

    Each has one node before it. 0, and nothing done, where the first or the next aren't reachable.
    """
    step = lat.d.connect(simple.right_id, simple.left_id)
    total, best = lat._best(c.starts[i], simple.left_id, simple.cost)
    if best is None or step == INHIBITED:
        return 0
    begins = c.starts[i:stop]
    ends = [*begins[1:], c.starts[stop] if stop < len(c.starts) else len(c.text)]
    step += simple.cost
    totals = range(total, total + step * len(begins), step) if step else repeat(total)
    chain = Chain(c.text, simple.words, begins, ends, totals, best)
    if len(begins) == len(c.starts):
        lat.whole = chain, total + step * (len(begins) - 1)
    else:
        lat.add(chain)
    return ends[-1]


# -- path rewriting -----------------------------------------------------------------
def concatenated(nodes: Sequence[Node], normalized: str | None = None) -> Node:
    ws = [n.word for n in nodes]
    join = lambda k: "".join(getattr(w, k) for w in ws)
    word = Word(0, -1, ws[0].left_id, ws[-1].right_id, sum(w.cost for w in ws), join("surface"), sum(w.length for w in ws), ws[0].pos_id, join("reading"), join("normalized") if normalized is None else normalized, join("dict_form"))
    return Node(nodes[0].begin, nodes[-1].end, word, False, nodes[-1].total)


def neko(d: Compiled, path: Sequence[Node], lat: Lattice) -> Sequence[Node]:
    """Particle ね + こと + particle ね, where noun ねこ and particle と are possible, becomes ねこ/と/ね."""
    if isinstance(path, Chain):  # beside which there are no other nodes
        return path
    if not any(n.word.surface == "こと" for n in path):
        return path
    out, i = [], 0
    pos = lambda n: d.pos[n.word.pos_id] if n.word.pos_id >= 0 else ("",) * 6
    final = lambda n: n.word.surface == "ね" and pos(n)[:2] == ("助詞", "終助詞")
    while i < len(path):
        if i + 2 < len(path) and final(path[i]) and path[i + 1].word.surface == "こと" and final(path[i + 2]):
            at = path[i].begin
            cat = lat.cheapest(at, at + 2, lambda n: n.word.surface == "ねこ" and pos(n)[0] == "名詞")
            to = lat.cheapest(at + 2, at + 3, lambda n: n.word.surface == "と" and pos(n)[0] == "助詞")
            if cat and to:
                out += [cat, to]
                i += 2
                continue
        out.append(path[i])
        i += 1
    return out


@dataclass
class JoinNumeric(PathRewrite):
    normalize: bool = True
    pos: Sequence[str] = ("名詞", "数詞", "*", "*", "*", "*")

    def set_up(self, d: Compiled) -> None:
        self.pos_id = d.pos_ids.get(tuple(self.pos), -2)

    def rewrite(self, c: Chars, path: list[Node], lat: Lattice) -> list[Node]:
        out, at, stop, own = [], 0, 0, self.pos_id
        for i in [i for i, n in enumerate(path) if n.word.pos_id == own]:
            if i < at:
                continue
            out += path[at:i]
            if stop <= i:
                stop = i
                while stop < len(path) and self._fits(c, path[stop]):
                    stop += 1
            j, value = self._longest(path, i, stop)
            if value is None:
                out.append(path[i])
                at = i + 1
                continue
            if j - i > 1 or (self.normalize and value != path[i].word.normalized):
                out.append(concatenated(path[i:j], value if self.normalize else None))
            else:
                out.append(path[i])
            at = j
        return out + path[at:]

    @staticmethod
    def _fits(c: Chars, n: Node) -> bool:
        return n.word.normalized in (".", ",") or all(m & _NUMERIC for m in c.masks[n.begin : n.end])

    @staticmethod
    def _longest(path: list[Node], i: int, stop: int) -> tuple[int, str | None]:
        """End and value of the longest numeral of whole nodes from i on, ``stop`` at most."""
        size = 32
        while True:
            nodes = path[i : min(i + size, stop)]
            text = "".join(n.word.normalized for n in nodes)
            read = numerals.read(text)
            # An error inside shows in every longer text too.
            if i + size >= stop or not read.accepted and read.at < len(text):
                break
            size *= 4
        ends = list(accumulate(len(n.word.normalized) for n in nodes))
        while not read.accepted:
            last = ends.pop()
            while ends and ends[-1] > min(read.at, last - 1):
                ends.pop()
            if not ends:
                return i, None
            read = numerals.read(text[: ends[-1]])
        return i + len(ends), read.normalized


@dataclass
class JoinKatakana(PathRewrite):
    pos: Sequence[str] = ("名詞", "普通名詞", "一般", "*", "*", "*")
    shortest: int = 3
    register: bool = False

    def set_up(self, d: Compiled) -> None:
        if self.shortest < 0:
            raise ValueError("the shortest length is negative")
        self.pos_id = d.pos_id(self.pos, self.register)

    def rewrite(self, c: Chars, path: list[Node], lat: Lattice) -> list[Node]:
        kata = BITS["KATAKANA"]
        if not c.has(kata):
            return path
        is_kata = [all(m & kata for m in c.masks[n.begin : n.end]) for n in path]
        out, i = [], 0
        while i < len(path):
            if not is_kata[i]:
                out.append(path[i])
                i += 1
                continue
            j = i
            while j < len(path) and is_kata[j]:
                j += 1
            group = path[i:j]
            if any(n.is_oov or n.end - n.begin < self.shortest for n in group):
                while group and c.masks[group[0].begin] & BITS["NOOOVBOW"]:
                    out.append(group.pop(0))
                if len(group) > 1:
                    begin, end = group[0].begin, group[-1].end
                    word = oov_word(c.text[begin:end], group[0].word.left_id, group[-1].word.right_id, sum(n.word.cost for n in group), self.pos_id)
                    group = [lat.cheapest(begin, end) or Node(begin, end, word, True, group[-1].total)]
            out += group
            i = j
        return out


def split(d: Compiled, path: Sequence[Node], mode: str) -> Sequence[Node]:
    """Mode A or B: nodes with several units become these; C leaves the path."""
    if isinstance(path, Chain):  # unknown words have no units
        return path
    if mode == "C":
        return list(path)
    out = []
    for n in path:
        units = () if n.is_oov else n.word.a_split if mode == "A" else n.word.b_split
        if len(units) < 2:
            out.append(n)
            continue
        at = n.begin
        for k, u in enumerate(units):
            w = d.words[u]
            end = n.end if k == len(units) - 1 else at + w.length
            out.append(Node(at, end, w, False, n.total))
            at = end
    return out
