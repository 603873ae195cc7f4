"""Token-ID output as ORC (operator 2).

Files hold documents in ascending id order, one row each: integer run-length encoded
ids, a row index every ``STRIDE`` rows and a Bloom filter on the document id, so that
readers take stripes in parallel and skip what the metadata rules out.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pretokens, ranges
from .bpe import BYTE_LEVEL, LONGEST, NOT_LATIN, BpeFile, Memo, bpe_file, int_lists
from .process import map_batches, process_cache
from .textkernel import slices

STRIDE = 1000
STRIPE_BYTES = 32 << 20
#: Bytes of texts whose pre-tokens are told apart at once, about.
UNIT = 4 << 20
#: Strings between spaces that a process remembers, in two generations.
RUNS = 400_000
#: ASCII marks; the apostrophe is left out, as it may begin a contraction.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
SCHEMA = "doc_id long, part int, pos long, n_tokens int, ids array<int>"


def library_ids(file: BpeFile, path: str, texts: list[str | None], end_id: int) -> list[bytes]:
    """Packed ids of whole texts from the library, ``end_id`` appended to each; for texts that ``pretokens`` leaves.

    The library's model encodes a pre-token when it is first met; texts with special
    strings are encoded by the library in one piece. A byte-level pre-token holds a space
    after other characters only in a run of white space, so a text may be cut before each
    space that has no white space beside it, and before and after each such line break.
    What lies between two cuts is remembered whole.
    """

    words, runs = _memos(file, path)
    end, out = struct.pack("<I", end_id), []
    cuts = file.pattern.pattern == BYTE_LEVEL and not file.folds
    for t in texts:
        if t and file.added_split is not None and file.added_split.search(t):
            out.append(array("I", file.library.encode(t, add_special_tokens=False).ids).tobytes() + end)
            continue
        # A line break gets a space before it, so it begins what follows a cut.
        rest = (t or "").replace("\n", " \n").split(" ") if cuts else [t or ""]
        first = rest.pop(0)
        if not first[-1:].isspace():
            try:
                packed = b"".join(map(runs.__getitem__, rest))
                out.append(b"".join(map(words.__getitem__, file.pieces(first))) + packed + end)
                continue
            except TypeError:  # joining None: a cut of this text isn't safe
                pass
        out.append(b"".join(map(words.__getitem__, file.pieces(t or ""))) + end)
    return out


def _memos(file: BpeFile, path: str) -> tuple[Memo, Memo]:
    """Packed ids of pre-tokens, and of what follows a space up to the next; both kept by the process."""
    files = process_cache().files
    if ("library", path) in files:
        return files["library", path]
    tokenize, chars, at = file.library.model.tokenize, dict(enumerate(file.chars)), attrgetter("id")
    blank = file.chars[32]

    def encode(word: str) -> bytes:
        if word.isascii() and word.isprintable():
            return array("I", map(at, tokenize(word.replace(" ", blank)))).tobytes()
        raw = word if word.isascii() else word.encode("utf-8", "surrogateescape").decode("latin-1")
        return array("I", map(at, tokenize(raw.translate(chars)))).tobytes()

    words = Memo(encode)

    def run(rest: str) -> bytes | None:
        """Ids of what follows a space or begins with a line break, if it isn't plain letters; None where the cut isn't safe."""
        if rest[:1] == "\n":
            line = rest[1:]
            if not line or line[0].isspace() or line[-1].isspace():
                return None
            return words["\n"] + b"".join(map(words.__getitem__, file.pieces(line)))
        core = rest.strip(_MARKS)
        plain = core.isalpha() if core.isascii() else core.isalpha() and not NOT_LATIN.search(core)
        if plain or (core.isascii() and core.isdigit()):
            if len(core) == len(rest):
                return encode(" " + rest)
            # Marks, one kind of characters, marks: three pre-tokens, of which the first has the space.
            start = rest.index(core)
            tail = rest[start + len(core) :]
            head = words[" " + rest[:start]] + words[core] if start else runs[core]
            return head + words[tail] if tail else head
        if not rest or rest[0].isspace() or rest[-1].isspace():
            return None
        if not core:
            return words[" " + rest]
        return b"".join(map(words.__getitem__, file.pieces(" " + rest)))

    class Runs(Memo):
        """As Memo, with plain ASCII letters encoded on the spot: most strings not remembered are such."""

        def __missing__(self, rest: str) -> bytes | None:
            value = self.old.get(rest)
            if value is None:
                value = array("I", map(at, tokenize(blank + rest))).tobytes() if rest.isalpha() and rest.isascii() else run(rest)
            if len(rest) <= LONGEST:
                if len(self) >= self.limit:
                    self.turn()
                self[rest] = value
            return value

    runs = Runs(run, RUNS)
    files["library", path] = words, runs
    return words, runs


def encoded(file: BpeFile, path: str, col: pa.Array, end_id: int) -> pa.Array:
    """Ids of whole texts, ``end_id`` appended to each: by pre-tokens of all texts at once where they can be cut so, else by ``library_ids``."""
    if file.pattern.pattern != BYTE_LEVEL or file.folds:
        return int_lists(library_ids(file, path, col.to_pylist(), end_id))
    ids, usual = pretokens.encoded(file, path, col, end_id)
    if usual.all():
        return ids
    rest = int_lists(library_ids(file, path, col.filter(pa.array(~usual)).to_pylist(), end_id))
    order = np.where(usual, np.cumsum(usual) - 1, len(ids) + np.cumsum(~usual) - 1)
    return pa.concat_arrays([ids, rest]).take(pa.array(order))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row and write it to ``path``.

    Columns: doc_id, part (rank of the file among the files), pos (row within it),
    n_tokens and ids. Null texts are empty documents with the end id alone. Rows with a null id come
    first, rows that repeat an id follow each other by text. Other columns are left out.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # Bounds come from the id column alone; a range exchange would read the texts for its sample.
    files = ranges.count(docs)
    part = ranges.number(F.col("doc_id"), ranges.bounds(src, "doc_id", files))
    dealt = src.repartitionById(files, part).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, part, pos = bpe_file(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in slices(whole, 1, UNIT):
                ids = encoded(file, tokenizer, b.column(1), end_id)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), ids.value_lengths(), ids], names=["doc_id", "part", "pos", "n_tokens", "ids"])
                pos += n

    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE_BYTES), "orc.rows.between.memory.checks": str(STRIDE)}
    map_batches(dealt, run, SCHEMA).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows written; with ``doc_ids`` only those, pruned by index and Bloom filter."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    ``start`` is the number of ids in all documents before it. Running sums are taken
    within a file and shifted by the sums of the files before; there is one row for
    each file in the shift, however many documents there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for b in batches:
            ids = b.column(4)
            offs = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4)
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).view(np.uint8)
            crc = [crc32(flat[4 * x : 4 * y]) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "pos", "n_tokens", "ids_crc32"])

    rows = map_batches(read_tokens(spark, path), run, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")
    within = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    files = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = files.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    out = rows.join(F.broadcast(shift), F.col("part") == F.col("__part"))
    return out.select("doc_id", (F.col("__before") + F.col("__in")).alias("start"), "n_tokens", "ids_crc32")
