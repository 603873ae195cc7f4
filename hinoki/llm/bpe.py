"""BPE encoding and decoding (operator 6), and the vocabulary files behind it.

Encoding keeps the symbols of a word in a doubly linked list and the ranks of the
possible merges in a priority queue; entries whose pair has changed since are stale
and skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .process import map_batches, process_cache
from .textkernel import slices

#: Pre-token pattern of byte-level files whose pre-tokenizer uses its own.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered by a process, two generations of so many at most, and the longest
#: that are: what a memo holds stays below some hundred bytes a word, whatever the texts.
MEMO, LONGEST = 250_000, 48
#: For encoding with decoding, which keeps more of each word.
MEMO_BOTH = 120_000
#: Texts with other characters go through the library's own normalizer and
#: pre-tokenizer, as character classes differ between versions of Unicode. The ranges
#: have been stable for long; U+001C to U+001F and U+0085 are left out on purpose.
_LATIN_RANGE = "\x00-\x1b\x20-\x84\x86-\u024f\u2010-\u2027\u2030-\u205e"
NOT_LATIN = re.compile(f"[^{_LATIN_RANGE}]")
_UNUSUAL = re.compile(f"[^{_LATIN_RANGE}\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
#: What the classes of the files' patterns are within the Latin range.
LETTERS, NUMBERS, WHITE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \xa0"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class BpeFile:
    """A tokenizers JSON file: vocabulary, merges, text rules."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in added.items()}
        self.added = added
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.suffix = model.get("end_of_word_suffix") or ""
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.vocab[a] << 32 | self.vocab[b]] = k
            self.merged.append(self.vocab[a + b])
        self.chars = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(self.chars)}
        inner = [self.vocab.get(c, -1) for c in self.chars]
        last = [self.vocab.get(c + self.suffix, -1) for c in self.chars]
        self.inner, self.last = inner, last
        pre = spec["pre_tokenizer"]
        steps = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        self.pattern = regex.compile(split or BYTE_LEVEL)
        latin = (split or BYTE_LEVEL).replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE}{LETTERS}{NUMBERS}]")
        for name, chars in ((r"\p{L}", LETTERS), (r"\p{N}", NUMBERS)):
            latin = latin.replace(f"[{name}]", name).replace(name, f"[{chars}]")
        self.latin = re.compile(latin.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))
        self.folds = spec["normalizer"] is not None
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.path = path

    @cached_property
    def library(self):
        """The library's own reading, for texts of unusual characters; padding and truncation stay unused."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    # -- text to words ------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens, as plain strings."""
        pattern = None
        if not NOT_LATIN.search(text):
            pattern = self.latin
        elif not _UNUSUAL.search(text):
            pattern = self.pattern
        if pattern is not None:
            if self.folds:
                if not text.isascii():
                    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
                    pattern = self.pattern if NOT_LATIN.search(low := text.lower()) else pattern
                    text = low
                else:
                    text = text.lower()
            return pattern.findall(text)
        lib = self.library
        if lib.normalizer is not None:
            text = lib.normalizer.normalize_str(text)
        return [bytes(self.byte_of[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in lib.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is an added token, string) runs of a text."""
        if self.added_split is None or not self.added_split.search(text):
            yield False, text
            return
        for k, run in enumerate(self.added_split.split(text)):
            if run:
                yield bool(k % 2), run

    # -- words to ids ---------------------------------------------------------
    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogateescape")
        sym = [self.inner[b] for b in raw[:-1]]
        sym.append(self.last[raw[-1]])
        return [s for s in sym if s >= 0]

    def merge(self, sym: list[int]) -> list[int]:
        """Apply the merges to a list of symbol ids."""
        n = len(sym)
        if n < 2:
            return sym
        rank, merged = self.rank, self.merged
        find, push, pop = rank.get, heapq.heappush, heapq.heappop
        left = list(range(-1, n - 1))
        right = list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = find(sym[i] << 32 | sym[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = right[i]
            if sym[i] < 0 or j >= n or find(sym[i] << 32 | sym[j]) != r:
                continue  # stale
            sym[i] = merged[r]
            sym[j] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                q = find(sym[i] << 32 | sym[k])
                if q is not None:
                    push(heap, q << 32 | i)
            h = left[i]
            if h >= 0:
                q = find(sym[h] << 32 | sym[i])
                if q is not None:
                    push(heap, q << 32 | h)
        return [s for s in sym if s >= 0]

    def encode_word(self, word: str) -> list[int]:
        return self.merge(self.symbols(word))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, run in self.parts(text):
            if special:
                out.append(self.added[run])
            else:
                for w in self.pieces(run):
                    out += self.encode_word(w)
        return out

    # -- ids to text ------------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included."""
        strings = [self.strings[i] for i in ids if i in self.strings]
        if not self.byte_decoder:
            return " ".join(strings)
        joined = "".join(strings)
        if all(c in self.byte_of for c in joined):
            return bytes(self.byte_of[c] for c in joined).decode("utf-8", "replace")
        raw = b"".join(bytes(self.byte_of[c] for c in s) if all(c in self.byte_of for c in s) else s.encode() for s in strings)
        return raw.decode("utf-8", "replace")


def bpe_file(path: str) -> BpeFile:
    """The file at ``path``, loaded once in a process."""
    files = process_cache().files
    if path not in files:
        files[path] = BpeFile(path)
    return files[path]


class Memo(dict):
    """word -> value, made on demand and bounded.

    When it is full it becomes the older generation, which goes at the next turn.
    ``seed`` holds values that stay.
    """

    def __init__(self, make: Callable[[str], object], limit: int = MEMO, seed: dict | None = None):
        super().__init__(seed or {})
        self.make, self.seed, self.limit, self.old = make, seed or {}, limit + len(seed or {}), {}

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= self.limit:
                self.turn()
            self[word] = value
        return value

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()
        self.update(self.seed)


def memo(path: str, kind: str, make: Callable[[str], object], seed: Callable[[], dict] | None = None, limit: int = MEMO) -> Memo:
    files = process_cache().files
    if (kind, path) not in files:
        files[kind, path] = Memo(make, limit, seed() if seed else None)
    return files[kind, path]


def encoded_texts(file: BpeFile, path: str, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
    """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""

    def make(word: str) -> tuple[bytes, str]:
        ids = file.encode_word(word)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(file.strings.__getitem__, ids))

    words = memo(path, "words", make, limit=MEMO_BOTH)
    spaced = not file.byte_decoder
    for text in texts:
        raw, said = [], []
        for special, run in file.parts(text or ""):
            if special:
                raw.append(struct.pack("<I", file.added[run]))
                said.append(run)
                continue
            pairs = list(map(words.__getitem__, file.pieces(run)))
            raw += [p[0] for p in pairs]
            if spaced:
                said += [p[1] for p in pairs if p[0]]
        ids = b"".join(raw)
        yield ids, " ".join(said) if spaced else file.decode(list(struct.unpack(f"<{len(ids) // 4}I", ids)))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row, in one narrow pass.

    Null texts count as empty and give no tokens. Special strings inside a text become
    their added token, as in the library. Texts of any length are encoded whole;
    repeated rows and null ids are rows like others. Other columns don't take part.
    An empty table gives an empty result.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        file = bpe_file(path)
        for whole in batches:
            for b in slices(whole, 1):
                n, one, two, raws = [], [], [], []
                for raw, said in encoded_texts(file, path, b.column(1).to_pylist()):
                    n.append(len(raw) // 4)
                    one.append(sha256(raw).hexdigest())
                    two.append(sha256(said.encode("utf-8")).hexdigest())
                    if with_ids:
                        raws.append(raw)
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(int_lists(raws))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = src.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return map_batches(src, run, schema.add("ids", T.ArrayType(T.IntegerType())) if with_ids else schema)


def int_lists(raws: list[bytes]) -> pa.Array:
    """list<int32> from packed little-endian 32-bit integers."""
    import numpy as np

    offs = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raws]))).astype(np.int32)
    flat = np.frombuffer(b"".join(raws), np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))
