"""Dictionaries: tables built with DataFrames, and the compiled object that tasks use."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INHIBITED = 32767
MAX_POS, MAX_WORDS_OF_HEADWORD, MAX_LEXICONS = 32767, 255, 16
WORD_MASK = (1 << 28) - 1
#: Largest dictionary that is compiled and broadcast: words, and cells of the matrix (2 bytes each).
MAX_WORDS, MAX_CELLS = 8_000_000, 1 << 27


# -- word ids ------------------------------------------------------------------
def encoded(dict_id: str | Column, word_id: str | Column) -> Column:
    """One integer of a dictionary's number (4 bits) and a word's number (28 bits); others raise an error."""
    d, w = (F.col(x) if isinstance(x, str) else x for x in (dict_id, word_id))
    bad = (d < 0) | (d >= MAX_LEXICONS) | (w < 0) | (w > WORD_MASK)
    return F.when(bad, F.raise_error(F.lit("dictionary or word id out of range")).cast("int")).otherwise(F.shiftleft(d.cast("int"), 28).bitwiseOR(w.cast("int")))


def dictionary_part(word: Column) -> Column:
    return F.shiftrightunsigned(word.cast("int"), 28)


def word_part(word: Column) -> Column:
    return word.bitwiseAND(F.lit(WORD_MASK))


def length_mask(length: Column) -> Column:
    """The bit of a length from 1 to 64; others raise an error."""
    return F.when(length.between(1, 64), F.call_function("shiftleft", F.lit(1).cast("bigint"), (length - 1).cast("int"))).otherwise(F.raise_error(F.lit("length out of range")).cast("bigint"))


def add_length(mask: Column, length: Column) -> Column:
    return mask.bitwiseOR(length_mask(length))


def has_length(mask: Column, length: Column) -> Column:
    return mask.bitwiseAND(length_mask(length)) != 0


# -- tables ------------------------------------------------------------------
def pos_table(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(pos_id, pos) in order of first use (dict_id, word_id); ``known`` keeps its ids in front."""
    first = rows.groupBy("pos").agg(F.min(F.struct("dict_id", "word_id")).alias("first"))
    start = 0
    if known is not None:
        first = first.join(known.select("pos"), "pos", "left_anti")
        start = known.count()
    # As many rows as there are tuples, at most MAX_POS.
    number = F.row_number().over(Window.orderBy("first")) - 1 + start
    checked = F.when(number < MAX_POS, number).otherwise(F.raise_error(F.lit(f"more than {MAX_POS} parts of speech")).cast("int"))
    new = first.select(checked.alias("pos_id"), "pos")
    return new if known is None else known.select("pos_id", "pos").unionByName(new)


def index_table(lexicon: DataFrame) -> DataFrame:
    """(headword, words): the words of each indexed headword in dictionary order."""
    words = F.array_sort(F.collect_list(F.struct("dict_id", "word_id")))
    return lexicon.filter("headword is not null").groupBy("headword").agg(words.alias("words"))


def _targets(refs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``refs`` (dict_id, word_id, pos_no, ref) with the word each names, as ref_dict and ref_word.

    References are ``n`` (system word), ``Un`` (word of the own dictionary) or an inline
    ``surface,pos1..pos6,reading``. An inline one means the own dictionary's first such
    word, else the first of those before it. Anything without a target raises an error.
    """
    number = F.regexp_extract("ref", r"^U?(\d+)$", 1)
    refs = refs.withColumn("number", number).withColumn("own", F.col("ref").startswith("U"))
    words = lexicon.select(F.col("dict_id").alias("ref_dict"), F.col("word_id").alias("ref_word"))
    missing = F.raise_error(F.concat(F.lit("unresolved reference "), F.col("ref"))).cast("int")
    plain = refs.filter("number <> ''").withColumn("want_dict", F.when(F.col("own"), F.col("dict_id")).otherwise(0)).withColumn("want_word", F.col("number").cast("int"))
    plain = plain.join(words, (F.col("want_dict") == F.col("ref_dict")) & (F.col("want_word") == F.col("ref_word")), "left")
    inline = refs.filter("number = ''").withColumn("k", F.split("ref", ","))
    named = lexicon.groupBy(F.col("surface").alias("s"), F.col("pos").alias("p"), F.col("reading").alias("r"), F.col("dict_id").alias("ref_dict")).agg(F.min("word_id").alias("ref_word"))
    found = inline.join(named, (F.col("k")[0] == F.col("s")) & (F.slice("k", 2, 6) == F.col("p")) & (F.col("k")[7] == F.col("r")) & (F.col("ref_dict") <= F.col("dict_id")), "left")
    best = found.groupBy("dict_id", "word_id", "pos_no", "ref").agg(F.min(F.struct(-F.col("ref_dict"), "ref_word")).alias("t"))
    best = best.select("dict_id", "word_id", "pos_no", "ref", (-F.col("t.col1")).alias("ref_dict"), F.col("t.ref_word").alias("ref_word"))
    every = plain.select(best.columns).unionByName(best)
    return every.select("dict_id", "word_id", "pos_no", F.coalesce("ref_dict", missing).alias("ref_dict"), "ref_word")


def split_refs(lexicon: DataFrame, column: str) -> DataFrame:
    """(dict_id, word_id, pos_no, ref_dict, ref_word) of ``a_split_ref``-like columns."""
    parts = F.filter(F.split(F.col(column), "/"), lambda x: ~x.isin("", "*", "A", "B", "C"))
    return _targets(lexicon.select("dict_id", "word_id", F.posexplode(parts).alias("pos_no", "ref")), lexicon)


def dictionary_forms(lexicon: DataFrame) -> DataFrame:
    """(dict_id, word_id, dict_form, form_dict, form_word): surface of the word referred to
    and its id, else the own surface and nulls."""
    refs = lexicon.filter(~F.coalesce("dict_form_ref", F.lit("*")).isin("", "*")).select("dict_id", "word_id", F.lit(0).alias("pos_no"), F.col("dict_form_ref").alias("ref"))
    target = _targets(refs, lexicon).drop("pos_no").join(lexicon.select(F.col("dict_id").alias("ref_dict"), F.col("word_id").alias("ref_word"), F.col("surface").alias("form")), ["ref_dict", "ref_word"], "left")
    target = target.select("dict_id", "word_id", "form", F.col("ref_dict").alias("form_dict"), F.col("ref_word").alias("form_word"))
    return lexicon.select("dict_id", "word_id", "surface").join(target, ["dict_id", "word_id"], "left").select("dict_id", "word_id", F.coalesce("form", "surface").alias("dict_form"), "form_dict", "form_word")


def resolved(rows: DataFrame, pos: DataFrame) -> DataFrame:
    """The lexicon table: rows with pos_id, dictionary forms and resolved unit lists."""
    out = rows.join(F.broadcast(pos), "pos").join(dictionary_forms(rows), ["dict_id", "word_id"])
    for column, name in (("a_split_ref", "a_split"), ("b_split_ref", "b_split"), ("structure_ref", "word_structure")):
        refs = split_refs(rows, column).groupBy("dict_id", "word_id").agg(F.array_sort(F.collect_list(F.struct("pos_no", encoded("ref_dict", "ref_word").alias("w")))).alias(name))
        out = out.join(refs.select("dict_id", "word_id", F.transform(name, lambda x: x["w"]).alias(name)), ["dict_id", "word_id"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
    return out.drop("dict_form_ref", "a_split_ref", "b_split_ref", "structure_ref")


def edit_connections(connection: DataFrame, edits: DataFrame) -> DataFrame:
    """Cells of ``edits`` (left, right, cost, seq) replace or add to those of ``connection``; the highest seq wins."""
    new = edits.groupBy("left", "right").agg(F.max_by("cost", "seq").alias("new"))
    return connection.join(new, ["left", "right"], "full").select("left", "right", F.coalesce("new", "cost").alias("cost"))


def inhibit(connection: DataFrame, pairs: Sequence[Sequence[int]]) -> DataFrame:
    rows = [(p[0], p[1], INHIBITED, i) for i, p in enumerate(pairs) if len(p) >= 2]
    return edit_connections(connection, connection.sparkSession.createDataFrame(rows, "left int, right int, cost int, seq int"))


def targeted(connection: DataFrame, lexicon: DataFrame, rules: DataFrame) -> DataFrame:
    """Set the cost between two entries; every word with their ids is affected.

    ``rules``: l_surface, l_pos, l_reading, r_surface, r_pos, r_reading, cost, and seq if
    their order matters: of rules for the same cell the one with the highest seq wins.
    """
    words = lexicon.groupBy("surface", "pos", "reading").agg(F.min(F.struct("dict_id", "word_id", "left_id", "right_id")).alias("w"))
    side = lambda x: words.select(F.col("surface").alias(f"{x}_surface"), F.col("pos").alias(f"{x}_pos"), F.col("reading").alias(f"{x}_reading"), F.col("w.right_id" if x == "l" else "w.left_id").alias(f"{x}_id"))
    hit = rules.join(side("l"), ["l_surface", "l_pos", "l_reading"], "left").join(side("r"), ["r_surface", "r_pos", "r_reading"], "left")
    checked = F.when(F.col("l_id").isNull() | F.col("r_id").isNull(), F.raise_error(F.lit("connection rule names an unknown entry")).cast("int")).otherwise(F.col("cost"))
    seq = F.col("seq") if "seq" in rules.columns else F.lit(0)
    return edit_connections(connection, hit.select(F.col("l_id").alias("left"), F.col("r_id").alias("right"), checked.alias("cost"), seq.alias("seq")))


# -- part-of-speech matching ------------------------------------------------------
def partial_pos(pos: Column, pattern: Sequence[str | None]) -> Column:
    """Prefix of 1 to 6 components, null for any."""
    if not 1 <= len(pattern) <= 6:
        raise ValueError("a partial POS has 1 to 6 components")
    out = F.lit(True)
    for i, p in enumerate(pattern):
        if p is not None:
            out = out & (pos[i] == p)
    return out


class PosMatcher:
    """A set of POS ids; an ordinary one-column DataFrame with set algebra."""

    def __init__(self, ids: DataFrame, table: DataFrame):
        self.ids, self.table = ids.select("pos_id").distinct(), table

    @classmethod
    def where(cls, table: DataFrame, predicate: Callable[[Column], Column]) -> PosMatcher:
        return cls(table.filter(predicate(F.col("pos"))), table)

    @classmethod
    def from_list(cls, table: DataFrame, patterns: Iterable[Sequence[str | None]]) -> PosMatcher:
        patterns = list(patterns)
        hit = F.lit(False)
        for p in patterns:
            hit = hit | partial_pos(F.col("pos"), p)
        return cls(table.filter(hit), table)

    def union(self, other: PosMatcher) -> PosMatcher:
        return PosMatcher(self.ids.union(other.ids), self.table)

    def intersection(self, other: PosMatcher) -> PosMatcher:
        return PosMatcher(self.ids.intersect(other.ids), self.table)

    def invert(self) -> PosMatcher:
        return PosMatcher(self.table.select("pos_id").subtract(self.ids), self.table)

    def filter(self, morphemes: DataFrame) -> DataFrame:
        # At most MAX_POS rows.
        return morphemes.join(F.broadcast(self.ids), "pos_id", "left_semi")


# -- the compiled dictionary --------------------------------------------------------
@dataclass(slots=True)
class Word:
    dict_id: int
    word_id: int
    left_id: int
    right_id: int
    cost: int
    surface: str
    length: int
    pos_id: int
    reading: str
    normalized: str
    dict_form: str
    a_split: tuple[int, ...] = ()
    b_split: tuple[int, ...] = ()
    synonyms: tuple[int, ...] = ()


@dataclass
class Compiled:
    """What a task needs to analyse: prefix index, words, matrix, POS list."""

    words: dict[int, Word]
    index: dict[str, list[Word]]
    matrix: np.ndarray
    pos: list[tuple[str, ...]]
    longest: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        for h in self.index:
            self.longest[h[0]] = max(self.longest.get(h[0], 0), len(h))
        self.longest_word = max(self.longest.values(), default=0)
        self.pos_ids = {p: i for i, p in reversed(list(enumerate(self.pos)))}
        self._flat()

    def _flat(self) -> None:
        self.rows, self.cols = self.matrix.shape
        self.cells = memoryview(np.ascontiguousarray(self.matrix, np.int16).reshape(-1))
        self.firsts = np.zeros(0x110000, bool)
        self.firsts[[ord(c) for c in self.longest]] = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cells", "firsts")}

    def may_begin(self, text: str) -> np.ndarray:
        """For each character whether any word begins with it."""
        return self.firsts[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._flat()

    def prefixes(self, text: str, at: int) -> list[Word]:
        """Words starting at an offset: by lexicon, then shorter headword, then word id."""
        most, get = min(self.longest.get(text[at], 0), len(text) - at), self.index.get
        if not most:
            return []
        found = [w for n in range(1, most + 1) for w in get(text[at : at + n], ())]
        if len(found) > 1:
            found.sort(key=lambda w: (w.dict_id, w.length, w.word_id))
        return found

    def connect(self, right_id: int, left_id: int) -> int:
        """Cost between a node's right id and the next node's left id; ids outside of the matrix are an error."""
        if not (0 <= right_id < self.rows and 0 <= left_id < self.cols):
            raise IndexError(f"no connection {right_id} {left_id}: the matrix has {self.rows} by {self.cols} cells")
        return self.cells[right_id * self.cols + left_id]

    def pos_id(self, pos: Sequence[str], register: bool = False) -> int:
        """Id of the exact tuple; unknown tuples are an error unless they may be registered."""
        pos = tuple(pos)
        if pos not in self.pos_ids:
            if not register:
                raise ValueError(f"unknown part of speech {','.join(pos)}")
            self.pos_ids[pos] = len(self.pos)
            self.pos.append(pos)
        return self.pos_ids[pos]

    def word_of(self, surface: str, pos_id: int, reading: str) -> Word | None:
        hits = [w for w in self.words.values() if (w.surface, w.pos_id, w.reading) == (surface, pos_id, reading)]
        return min(hits, key=lambda w: (w.dict_id, w.word_id), default=None)


class Dictionary:
    """A system lexicon with user lexicons: tables, persisted as Parquet, and their compiled form."""

    TABLES = ("lexicon", "pos", "connection")

    def __init__(self, lexicon: DataFrame, pos: DataFrame, connection: DataFrame):
        self.lexicon, self.pos, self.connection = lexicon, pos, connection

    @classmethod
    def build(cls, rows: Sequence[DataFrame], connection: DataFrame) -> Dictionary:
        """From parsed rows of the system lexicon and of any user lexicons, in order."""
        if len(rows) > MAX_LEXICONS:
            raise ValueError("too many lexicons")
        union = None
        for i, r in enumerate(rows):
            r = r.withColumn("dict_id", F.lit(i))
            union = r if union is None else union.unionByName(r)
        pos = pos_table(union)
        return cls(resolved(union, pos), pos, connection)

    def save(self, path: str) -> None:
        for t in self.TABLES:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Dictionary:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in cls.TABLES))

    def compile(self) -> Compiled:
        """The dictionary, not the corpus, for broadcasting to tasks; its size is checked first.

        Tables come as Arrow columns. Words' ids must lie inside the matrix.
        """
        size = self.connection.agg((F.max("left") + 1).alias("rows"), (F.max("right") + 1).alias("cols"), F.min(F.least("left", "right")).alias("low")).first()
        rows, cols, n = size["rows"] or 1, size["cols"] or 1, self.lexicon.count()
        if n > MAX_WORDS or rows * cols > MAX_CELLS or (size["low"] or 0) < 0:
            raise ValueError(f"a dictionary of {n} words and {rows} by {cols} connections is out of bounds")
        cells = self.connection.select("left", "right", F.col("cost").cast("short").alias("cost")).toArrow()
        matrix = np.zeros((rows, cols), np.int16)
        matrix[cells.column("left").to_numpy(), cells.column("right").to_numpy()] = cells.column("cost").to_numpy()
        names = ["dict_id", "word_id", "left_id", "right_id", "cost", "surface", "headword_chars", "pos_id", "reading", "normalized", "dict_form", "a_split", "b_split", "synonym_gids"]
        table = self.lexicon.select(*names, "headword").orderBy("dict_id", "word_id").toArrow()
        words, index = {}, {}
        for batch in table.to_batches():
            columns = [batch.column(i).to_pylist() for i in range(len(names))]
            for headword, *fields, a, b, synonyms in zip(batch.column("headword").to_pylist(), *columns):
                w = Word(*fields, tuple(a), tuple(b), tuple(synonyms))
                words[w.dict_id << 28 | w.word_id] = w
                if headword is not None:
                    if not (0 <= w.left_id < cols and 0 <= w.right_id < rows):
                        raise ValueError(f"{headword}: connection ids {w.left_id} and {w.right_id} are outside of the matrix")
                    index.setdefault(headword, []).append(w)
        too_many = [h for h, ws in index.items() if len(ws) > MAX_WORDS_OF_HEADWORD]
        if too_many:
            raise ValueError(f"too many words of {too_many[0]}")
        pos = [tuple(r["pos"]) for r in self.pos.orderBy("pos_id").collect()]
        return Compiled(words, index, matrix, pos)

    def stats(self) -> DataFrame:
        """(name, entries) of each part."""
        parts = [self.lexicon.groupBy(F.concat(F.lit("lexicon "), F.col("dict_id")).alias("name")).agg(F.count("*").alias("entries"))]
        parts += [getattr(self, t).agg(F.lit(t).alias("name"), F.count("*").alias("entries")) for t in ("pos", "connection")]
        return parts[0].union(parts[1]).union(parts[2])

    def printed(self) -> DataFrame:
        """One CSV line for each word, as the lexicon reader takes it."""
        def esc(c: Column) -> Column:
            return F.replace(F.replace(c, F.lit(","), F.lit("\\u002c")), F.lit('"'), F.lit("\\u0022"))

        lex = self.lexicon
        own = lambda d, w: F.when(d == 0, w.cast("string")).otherwise(F.concat(F.lit("U"), w))
        refs = lambda c: F.when(F.size(c) == 0, "*").otherwise(F.array_join(F.transform(c, lambda x: own(dictionary_part(x), word_part(x))), "/"))
        unit = F.when(F.size("a_split") == 0, "A").when(F.size("b_split") == 0, "B").otherwise("C")
        syn = F.when(F.size("synonym_gids") == 0, "*").otherwise(F.array_join(F.transform("synonym_gids", lambda x: F.lpad(x.cast("string"), 6, "0")), "/"))
        form = F.when(F.col("form_word").isNull(), "*").otherwise(own(F.col("form_dict"), F.col("form_word")))
        line = F.concat_ws(",", esc(F.coalesce("headword", "surface")), "left_id", "right_id", "cost", esc(F.col("surface")), F.array_join("pos", ","), esc(F.col("reading")), esc(F.col("normalized")), form, unit, refs("a_split"), refs("b_split"), refs("word_structure"), syn)
        return lex.select("dict_id", "word_id", line.alias("line"))
