"""Pre-tokens of whole batches, for byte-level files whose pre-tokenizer uses its own pattern.

Texts of Latin characters are cut from byte classes, with nothing that runs per character
or per pre-token in Python; each distinct pre-token of a batch is looked up once. Texts
with other characters, no-break spaces or special strings are left to the caller.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from .bpe import LETTERS, LONGEST, NOT_LATIN, NUMBERS, WHITE, BpeFile
from .process import process_cache
from .textkernel import buffers

#: Pre-tokens that a process remembers, and ids of them for each, on average at most.
REMEMBERED, IDS_EACH = 400_000, 8
#: Bytes of new pre-tokens in one call of the library, about; it holds some dozen bytes for each.
_CALL = 256 << 10
_WHITE, _LETTER, _NUMBER, _MARK, _OTHER = range(5)


def _kind(c: int) -> int:
    """The class of a code point in the file's pattern; _OTHER where it isn't certain, or white space of two bytes."""
    ch = chr(c)
    if NOT_LATIN.match(ch) or c == 0xA0:
        return _OTHER
    return next((kind for kind, chars in ((_WHITE, WHITE), (_LETTER, LETTERS), (_NUMBER, NUMBERS)) if re.match(f"[{chars}]", ch)), _MARK)


#: By byte, and by code point for those of two bytes. What follows a lead byte gets the lead's class.
_BYTES = np.array([_kind(c) if c < 128 else _OTHER for c in range(256)], np.uint8)
_TWO = np.array([_kind(c) for c in range(0x800)], np.uint8)
#: Of the code points from U+2000 on.
_THREE = np.array([_kind(0x2000 + c) for c in range(0x60)], np.uint8)


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 texts; bytes of one character have the same."""
    out = _BYTES[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead]
        two = lead[first < 0xE0]
        out[two] = out[two + 1] = _TWO[(data[two].astype(np.int64) & 31) << 6 | (data[two + 1] & 63)]
        three = lead[first == 0xE2]
        code = (data[three + 1].astype(np.int64) & 63) << 6 | (data[three + 2] & 63)
        known = np.where(code < 0x60, _THREE[np.minimum(code, 0x5F)], _OTHER)
        out[three] = out[three + 1] = out[three + 2] = known
    return out


def usual_rows(file: BpeFile, data: np.ndarray, offs: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Rows that ``cuts`` can take: all characters are of known classes, and there is no special string."""
    at = [np.flatnonzero(kinds == _OTHER)]
    raw = data.tobytes()
    for content in file.added:
        special, found, hits = content.encode(), 0, []
        while (found := raw.find(special, found)) >= 0:
            hits.append(found)
            found += 1
        at.append(np.array(hits, np.int64))
    rows = np.ones(len(offs) - 1, bool)
    rows[np.searchsorted(offs, np.concatenate(at), "right") - 1] = False
    return rows


def cuts(data: np.ndarray, offs: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of usual rows begin, ascending, and the end of the last."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    solid = kinds != _WHITE
    begin = np.empty(n + 1, bool)
    begin[0] = begin[n] = True
    # A class begins where the one before ends; a space belongs to what follows it.
    np.not_equal(kinds[1:], kinds[:-1], out=begin[1:n])
    begin[1:n] &= ~solid[1:] | (data[:-1] != 32)
    # Of white space before something else the last character is left over.
    begin[: n - 1] |= ~solid[:-1] & solid[1:] & ~edge[1:n]
    begin |= edge
    mark = np.flatnonzero((data == 39) & begin[:n])
    if len(mark):
        # A contraction where an apostrophe begins a pre-token, within the row.
        after = np.zeros((2, len(mark)), np.uint8)
        for k in (1, 2):
            inside = mark + k < n
            after[k - 1, inside] = data[mark[inside] + k]
        near, far = ~edge[mark + 1], ~edge[np.minimum(mark + 1, n)] & ~edge[np.minimum(mark + 2, n)]
        one = near & np.isin(after[0], np.frombuffer(b"stmd", np.uint8))
        two = np.zeros(len(mark), bool)
        for a, b in (b"re", b"ve", b"ll"):
            two |= (after[0] == a) & (after[1] == b)
        two &= far
        begin[mark[one | two] + 1] = False
        begin[mark[one] + 2] = True
        begin[mark[two] + 3] = True
    return np.flatnonzero(begin)


class Remembered:
    """Ids of pre-tokens as the library's model gives them, each encoded when a process meets it.

    All ids stand in one array. When there are too many, those that most batches had stay,
    half of them at most. The first entry is the end of a document.
    """

    def __init__(self, file: BpeFile, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        # The library's model by itself: what it gets is cut already.
        self.library = Tokenizer(file.library.model)
        self.library.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.tokenize = file.library.model.tokenize
        # The characters of bytes; none of them is a space, and 0xFF is in no UTF-8.
        self.chars = np.array([ord(c) for c in file.chars], np.uint32)
        self.chars[255] = 32
        # Numbers of bytes that ids stand for; exact where every byte has an id.
        self.exact = min(file.inner) >= 0 and not file.suffix
        self.sizes = np.zeros(max(file.strings) + 1, np.int64)
        for word, i in file.vocab.items():
            self.sizes[i] = len(word)
        self.at: dict[str | None, int] = {None: 0}
        self.ids, self.ends, self.seen = np.array([end_id], np.int32), np.array([0, 1], np.int64), np.zeros(1, np.int64)

    def _mapped(self, raw: bytes) -> str:
        return self.chars[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")

    def _one(self, raw: bytes) -> np.ndarray:
        return np.array([t.id for t in self.tokenize(self._mapped(raw))], np.int32)

    def _encode(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of new pre-tokens and their number for each, in pieces."""
        ids, counts, some, size = [], [], [], 0

        def call() -> None:
            # This call doesn't tell the words of its ids.
            got = np.array(self.library.encode_batch_fast([self._mapped(b"\xff".join(some))], add_special_tokens=False)[0].ids, np.int32)
            done = np.concatenate(([0], np.cumsum(self.sizes[got])))
            ends = np.cumsum([0, *map(len, some)])
            at = np.searchsorted(done, ends)
            if self.exact and done[-1] == ends[-1] and (done[at] == ends).all():
                ids.append(got)
                counts.append(np.diff(at))
            else:
                one = list(map(self._one, some))
                ids.extend(one)
                counts.append(np.array(list(map(len, one))))
            some.clear()

        for word in words:
            raw = word.encode()
            if len(raw) > 4 * LONGEST:
                if some:
                    call()
                    size = 0
                ids.append(self._one(raw))
                counts.append(np.array([len(ids[-1])]))
                continue
            some.append(raw)
            size += len(raw)
            if size > _CALL:
                call()
                size = 0
        if some:
            call()
        return ids, counts

    def places(self, words: list[str]) -> np.ndarray:
        """The entries of distinct pre-tokens."""
        if len(self.at) > REMEMBERED or len(self.ids) > REMEMBERED * IDS_EACH:
            self.turn()
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            have = len(self.seen)
            missed = [words[i] for i in new.tolist()]
            at[new] = np.arange(have, have + len(new))
            self.at.update(zip(missed, range(have, have + len(new))))
            ids, counts = self._encode(missed)
            self.ids = np.concatenate([self.ids, *ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
            self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.seen[at] += 1
        return at

    def turn(self) -> None:
        words = list(self.at)
        # Long ones go; what one batch only had goes too.
        short = np.fromiter((w is None or len(w) <= LONGEST for w in words), bool, len(words))
        self.seen[0] = max(self.seen.max(), 2)
        keep = np.flatnonzero(short & (self.seen > 1))
        if len(keep) > REMEMBERED // 2:
            keep = np.sort(keep[np.argsort(-self.seen[keep], kind="stable")[: REMEMBERED // 2]])
        lists = self.lists(keep)
        self.at = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.ids, self.ends = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        self.seen = self.seen[keep] >> 1

    def lists(self, at: np.ndarray) -> pa.ListArray:
        """The ids of entries, a list for each."""
        size = np.diff(self.ends)[at]
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        where = np.repeat((self.ends[at] - ends[:-1]).astype(np.int32), size)
        where += np.arange(len(where), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(self.ids[where]))


def remembered(file: BpeFile, path: str, end_id: int) -> Remembered:
    files = process_cache().files
    if ("remembered", path, end_id) not in files:
        files["remembered", path, end_id] = Remembered(file, end_id)
    return files["remembered", path, end_id]


def encoded(file: BpeFile, path: str, col: pa.Array, end_id: int) -> tuple[pa.ListArray, np.ndarray]:
    """Ids of each text with the end of a document for the rows that can be cut here, and which rows these are."""
    data, offs = buffers(col)
    kinds = classes(data)
    usual = usual_rows(file, data, offs, kinds)
    if not usual.all():
        data, offs = buffers(col.filter(pa.array(usual)))
        kinds = classes(data)
    begin = cuts(data, offs, kinds)
    strings = pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data))
    distinct = strings.dictionary_encode()
    memo = remembered(file, path, end_id)
    at = memo.places(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())[distinct.indices.to_numpy()]
    # The end of a document after the pre-tokens of each row.
    last = np.searchsorted(begin[:-1], offs[1:]) + np.arange(len(offs) - 1)
    whole = np.zeros(len(at) + len(last), np.int64)
    inner = np.ones(len(whole), bool)
    inner[last] = False
    whole[inner] = at
    lists = memo.lists(whole)
    ends = np.concatenate(([0], last + 1))
    return pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[ends]), lists.values), usual
