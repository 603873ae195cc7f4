"""Token counts with the whole-token shortcut (operator 10).

Which vocabulary strings encode alone as one token is proved offline, by merging each
of them. Pre-tokens equal to such a string count as one directly; only the rest is merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BpeFile, bpe_file, memo
from .process import map_batches
from .textkernel import slices


def whole_tokens(file: BpeFile) -> dict[str, int]:
    """Vocabulary strings that the merges turn into their own single token, each with count 1."""
    out = {}
    for s, i in file.vocab.items():
        body = s.removesuffix(file.suffix) if file.suffix else s
        if not body or any(c not in file.byte_of for c in body):
            continue
        raw = bytes(file.byte_of[c] for c in body)
        try:
            word = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if file.encode_word(word) == [i]:
            out[word] = 1
    return out


def count_texts(file: BpeFile, path: str, texts: list[str | None], whole: Callable[[], dict[str, int]]) -> Iterator[int]:
    counts = memo(path, "counts", lambda word: len(file.encode_word(word)), seed=whole)
    for text in texts:
        n = 0
        for special, run in file.parts(text or ""):
            n += 1 if special else sum(map(counts.__getitem__, file.pieces(run)))
        yield n


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, in one narrow pass.

    Null texts count as empty: no bytes, no tokens. Special strings inside a text are
    one token each, as in the library's default. Texts are never truncated; repeated
    rows and null ids are rows like others, other columns don't take part. An empty
    table gives an empty result.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # Proved once, before the job; as many strings as the vocabulary has at most.
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(bpe_file(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        file = bpe_file(path)
        for whole in batches:
            for b in slices(whole, 1):
                size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                n = pa.array(count_texts(file, path, b.column(1).to_pylist(), lambda: proved.value), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = src.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return map_batches(src, run, schema)
