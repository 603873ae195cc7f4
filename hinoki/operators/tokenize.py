"""The analyzer as DataFrame operators: one narrow Arrow stage, the dictionary broadcast."""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sentences
from ..functions.batches import map_dealt, slices
from ..functions.charclass import Categories
from ..functions.normalize import DefaultRewrite, Edited, normalized
from ..plans.dictionary import Compiled
from . import lattice
from .lattice import Chain, Chars, Lattice, Node

MORPHEME = "begin int, end int, surface string, pos array<string>, pos_id int, dictionary_form string, normalized_form string, reading_form string, is_oov boolean, word_id int, dictionary_id int, synonym_group_ids array<int>, total_cost long, original string"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
FIELDS = dict(f.split(" ") for f in MORPHEME.split(", "))
OFFSETS = ("code points", "utf-16", "bytes")
MODES = ("A", "B", "C")


@dataclass
class Engine:
    """A compiled dictionary with its plugin chains. Stateless between texts."""

    dictionary: Compiled
    input: Sequence = field(default_factory=lambda: [DefaultRewrite.standard()])
    oov: Sequence = ()
    path: Sequence = ()
    categories: Categories = field(default_factory=Categories)

    def __post_init__(self):
        for p in (*self.input, *self.oov, *self.path):
            p.set_up(self.dictionary)

    # -- one text ---------------------------------------------------------------
    def lattice(self, text: str) -> tuple[Chars, Lattice, Sequence[Node]]:
        c = Chars.of(text, self.categories)
        lat = lattice.build(self.dictionary, c, self.oov)
        return c, lat, lat.path()

    def path_of(self, text: str, mode: str) -> Sequence[Node]:
        """Best path of a normalized text, rewritten and split."""
        if mode not in MODES:
            raise ValueError(f"unknown split mode {mode}")
        for p in self.path:
            p.validate_split_mode(mode)
        if not text:
            return []
        c, lat, path = self.lattice(text)
        path = lattice.neko(self.dictionary, path, lat)
        if self.path:
            path = list(path)
        for p in self.path:
            path = p.rewrite(c, path, lat)
        return lattice.split(self.dictionary, path, mode)

    def analyse(self, edited: Edited, mode: str) -> list[dict]:
        made = self.columns([(edited, self.path_of(edited.text, mode))], list(FIELDS), OFFSETS[0])
        return made.to_pylist()[0]

    def tokenize(self, text: str, mode: str = "C") -> list[dict]:
        return self.analyse(normalized(text, self.input), mode)

    def columns(self, done: Sequence[tuple[Edited, Sequence[Node]] | None], fields: Sequence[str], offsets: str | Sequence[str]) -> pa.ListArray:
        """list<struct> of the fields of each text's nodes, column by column; None gives null."""
        texts = list(filter(None, done))
        pos = self.dictionary.pos
        # What a chain knows without its nodes doesn't make them.
        nodes = [n for _, own in texts for n in own] if set(fields) - {"begin", "end", "surface", "is_oov"} else []
        makers = {
            "surface": lambda: [x for _, own in texts for x in (own.surfaces() if isinstance(own, Chain) else (n.word.surface for n in own))],
            "pos": lambda: [pos[n.word.pos_id] for n in nodes],
            "pos_id": lambda: [n.word.pos_id for n in nodes],
            "dictionary_form": lambda: [n.word.dict_form for n in nodes],
            "normalized_form": lambda: [n.word.normalized for n in nodes],
            "reading_form": lambda: [n.word.reading for n in nodes],
            "is_oov": lambda: [x for _, own in texts for x in (repeat(True, len(own)) if isinstance(own, Chain) else (n.is_oov for n in own))],
            "word_id": lambda: [n.word.word_id for n in nodes],
            "dictionary_id": lambda: [-1 if n.is_oov else n.word.dict_id for n in nodes],
            "synonym_group_ids": lambda: [n.word.synonyms for n in nodes],
            "total_cost": lambda: [n.total for n in nodes],
            "original": lambda: [t.original[t.origin[n.begin] : t.origin[n.end]] for t, own in texts for n in own],
        }
        columns = {}
        for f in fields:
            if f in makers:
                columns[f] = pa.array(makers[f](), _ARROW[FIELDS[f]])
                continue
            side = lattice.begins if f == "begin" else lattice.ends
            at = [t.origin[i] for t, own in texts for i in side(own)]
            for suffix, unit in _suffixes(offsets).items():
                columns[f + suffix] = pa.array(_in_unit(at, texts, unit), pa.int32())
        flat = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
        ends = np.concatenate(([0], np.cumsum([len(x[1]) if x else 0 for x in done]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in done], pa.bool_()))

    def veto(self, text: str, eos: int) -> bool:
        """Whether a word spans the boundary, or ends at it with more than one character."""
        for at in range(max(0, eos - self.dictionary.longest_word), eos):
            for w in self.dictionary.prefixes(text, at):
                if at + w.length > eos or (at + w.length == eos and w.length > 1):
                    return True
        return False

    def split_sentences(self, text: str, limit: int = sentences.LIMIT) -> list[tuple[int, int, Edited]]:
        """(begin, end, normalized slice) of each sentence, offsets in the original text."""
        t = normalized(text, self.input)
        out = []
        for a, b in sentences.split(t.text, self.veto, limit):
            out.append((t.origin[a], t.origin[b], t.part(a, b)))
        return out

    def dump(self, text: str) -> str:
        """Nodes, best path and A-mode path as JSON."""
        _, lat, path = self.lattice(normalized(text, self.input).text)
        row = lambda n: {"begin": n.begin, "end": n.end, "wordId": n.word.word_id, "surface": n.word.surface, "dictionaryId": n.word.dict_id, "isOOV": n.is_oov, "leftId": n.word.left_id, "rightId": n.word.right_id, "cost": n.word.cost, "totalCost": n.total, "isConnectedToBOS": n.total is not None}
        return json.dumps({"nodes": [row(n) for n in lat.nodes()], "bestPath": [row(n) for n in path], "splitPath": [row(n) for n in lattice.split(self.dictionary, path, "A")]}, ensure_ascii=False)

    # -- tables ----------------------------------------------------------------------
    def _mapped(self, df: DataFrame, text_col: str, types: dict[str, T.DataType], per_batch) -> DataFrame:
        """Rows of ``df`` without the text, repeated as ``per_batch(engine, texts)`` says.

        It returns (row numbers, Arrow columns).
        """
        keep = [c for c in df.columns if c != text_col]
        src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
        engine = df.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType(src.drop("__text").schema.fields + [T.StructField(n, t) for n, t in types.items()])
        n_kept = len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = engine.value
            for whole in batches:
                for b in slices(whole, n_kept):
                    gc.disable()  # nodes have no cycles, but many are alive at once
                    try:
                        take, made = per_batch(own, b.column(n_kept).to_pylist())
                    finally:
                        gc.enable()
                    index = pa.array(take, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(index) for k in range(n_kept)), *made], names=schema.names)

        return map_dealt(src, run, schema)

    def tokenize_table(self, df: DataFrame, text_col: str = "text", mode: str = "C", tolerant: bool = False, fields: Sequence[str] | None = None, offsets: str | Sequence[str] = OFFSETS[0]) -> DataFrame:
        """``df`` with ``morphemes`` and ``error`` for the text column; null and empty texts have none.

        ``fields`` names the morpheme fields wanted, all by default; ``offsets`` counts
        begin and end in code points, UTF-16 units or UTF-8 bytes of the original text. For
        several units at once these fields have names like ``end_utf_16``.
        With ``tolerant`` a text that can't be analysed gets an error message and a null
        list instead of failing the job.
        """
        wanted = _wanted(fields, offsets)

        def per_batch(own: Engine, texts: list[str | None]):
            done, errors = [], []
            for text in texts:
                try:
                    t = normalized(text or "", own.input)
                    done.append((t, own.path_of(t.text, mode)))
                    errors.append(None)
                except ValueError as e:
                    if not tolerant:
                        raise
                    done.append(None)
                    errors.append(str(e))
            return range(len(texts)), [own.columns(done, wanted, offsets), pa.array(errors, pa.string())]

        return self._mapped(df, text_col, {"morphemes": _list_type(wanted, offsets), "error": T.StringType()}, per_batch)

    def sentence_table(self, df: DataFrame, text_col: str = "text", mode: str = "C", limit: int = sentences.LIMIT, fields: Sequence[str] | None = None) -> DataFrame:
        """A row for each sentence: sent_no, sent_begin, sent_end, sentence, morphemes."""
        wanted = _wanted(fields, OFFSETS[0])
        types = {f.name: f.dataType for f in T.StructType.fromDDL("sent_no int, sent_begin int, sent_end int, sentence string")}

        def per_batch(own: Engine, texts: list[str | None]):
            rows = [(i, k, a, b, part) for i, text in enumerate(texts) for k, (a, b, part) in enumerate(own.split_sentences(text or "", limit))]
            done = [(part, own.path_of(part.text, mode)) for *_, part in rows]
            numbers = [pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2, 3)]
            return [r[0] for r in rows], [*numbers, pa.array([texts[r[0]][r[2] : r[3]] for r in rows], pa.string()), own.columns(done, wanted, OFFSETS[0])]

        return self._mapped(df, text_col, types | {"morphemes": _list_type(wanted)}, per_batch)

    def dump_table(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        def per_batch(own: Engine, texts: list[str | None]):
            return range(len(texts)), [pa.array([own.dump(text or " ") for text in texts], pa.string())]

        return self._mapped(df, text_col, {"dump": T.StringType()}, per_batch)


def _wanted(fields: Sequence[str] | None, offsets: str | Sequence[str]) -> list[str]:
    wanted, units = list(FIELDS if fields is None else fields), [offsets] if isinstance(offsets, str) else offsets
    if not wanted or not units or not set(wanted) <= set(FIELDS) or not set(units) <= set(OFFSETS):
        raise ValueError("unknown morpheme field or unit of offsets")
    return wanted


def _suffixes(offsets: str | Sequence[str]) -> dict[str, str]:
    """What the names of begin and end get -> unit."""
    return {"": offsets} if isinstance(offsets, str) else {f"_{u.replace(' ', '_').replace('-', '_')}": u for u in offsets}


def _list_type(fields: Sequence[str], offsets: str | Sequence[str] = OFFSETS[0]) -> T.ArrayType:
    names = {f + x: FIELDS[f] for f in fields for x in (_suffixes(offsets) if f in ("begin", "end") else ("",))}
    return T.ArrayType(T.StructType.fromDDL(", ".join(f"`{f}` {kind}" for f, kind in names.items())))


def _in_unit(at: list[int], texts: Sequence[tuple[Edited, Sequence[Node]]], unit: str) -> Sequence[int]:
    """Offsets in code points of the texts' nodes, one after the other, in the wanted unit."""
    if unit == OFFSETS[0] or all(t.original.isascii() for t, _ in texts):
        return at
    out, done = np.array(at, np.int64), 0
    for t, own in texts:
        if own and not t.original.isascii():
            points = np.frombuffer(t.original.encode("utf-32-le", "surrogatepass"), np.uint32)
            size = 1 + (points > 0xFFFF) if unit == "utf-16" else 1 + (points > 0x7F).astype(int) + (points > 0x7FF) + (points > 0xFFFF)
            out[done : done + len(own)] = np.concatenate(([0], np.cumsum(size)))[out[done : done + len(own)]]
        done += len(own)
    return out


def morphemes(df: DataFrame) -> DataFrame:
    """One row for each morpheme, with pos_no."""
    keep = [c for c in df.columns if c not in ("morphemes", "error")]
    return df.select(*keep, F.posexplode("morphemes").alias("pos_no", "m")).select(*keep, "pos_no", "m.*")
