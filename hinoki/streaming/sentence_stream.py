"""Sentences from a stream of chunks: a carry-over buffer for each key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import sentences
from ..functions.batches import bound_batches
from ..functions.normalize import normalized
from ..operators.tokenize import Engine

OUTPUT = "key string, sent_no int, sentence string, surfaces string"
#: A bucket's open keys as JSON: a list of key, tail, next_seq, sent_no, waiting (pairs of seq and chunk), last_seq.
STATE = "keys string"
BUCKETS = 1 << 14


def complete(engine: Engine, text: str, ended: bool, limit: int) -> tuple[list[str], str]:
    """(sentences that no later chunk can change, rest).

    The text is normalized once; white space before a sentence isn't part of it.
    """
    t, out, at = normalized(text, engine.input), [], 0
    while True:
        start = at
        while start < len(t.text) and t.text[start].isspace():
            start += 1
        if start == len(t.text):
            return out, "" if ended else text[t.origin[at] :]
        n = sentences.find_eos(t.text[start : start + 2 * limit], engine.veto, limit)
        end = start + abs(n)
        # A boundary at the very end may still grow; a cut needs a full window.
        if not ended and (end >= len(t.text) or (n < 0 and len(t.text) - start < limit)):
            return out, text[t.origin[at] :]
        out.append(text[t.origin[start] : t.origin[end]])
        at = end


def sentence_stream(chunks: DataFrame, engine: Engine, mode: str = "C", limit: int = sentences.LIMIT, buckets: int = BUCKETS) -> DataFrame:
    """(key, seq, chunk, last) in any order of arrival -> (key, sent_no, sentence, surfaces).

    ``seq`` counts a key's chunks from 0 and ``last`` marks the final one. Chunks that
    come early wait in the state until their turn; what can still grow stays there. A key's
    state goes once the final chunk is done; its numbers start again if it comes back.
    Without a size cut the sentences don't depend on how the text was cut into chunks.

    Spark's price of a group is that of many sentences, so keys share groups by hash, of which
    there are ``buckets`` at most. A bucket with new chunks has the state of all its open keys
    read and written; with very many open keys, take more buckets. A query that goes on from a
    checkpoint keeps their number.
    """
    bound_batches(chunks.sparkSession)
    shared = chunks.sparkSession.sparkContext.broadcast(engine)

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, rows = shared.value, []
        kept = {k: (tail, at, number, dict(map(tuple, waiting)), last) for k, tail, at, number, waiting, last in json.loads(state.get[0])} if state.exists else {}
        touched: dict[str, None] = {}
        for f in frames:
            for key, seq, chunk, is_last in zip(f["key"].tolist(), f["seq"].tolist(), f["chunk"].tolist(), f["last"].tolist()):
                tail, at, number, waiting, last = kept.get(key) or ("", 0, 0, {}, -1)
                if seq >= at:
                    waiting[seq] = chunk or ""
                kept[key] = (tail, at, number, waiting, seq if is_last else last)
                touched[key] = None
        for key in touched:
            tail, at, number, waiting, last = kept[key]
            while at in waiting:
                tail += waiting.pop(at)
                at += 1
            ended = 0 <= last < at
            done, tail = complete(own, tail, ended, limit)
            rows += [(key, number + i, s, _surfaces(own, s, mode)) for i, s in enumerate(done)]
            if ended:
                del kept[key]
            else:
                kept[key] = (tail, at, number + len(done), waiting, last)
        if kept:
            state.update((json.dumps([(k, tail, at, number, list(waiting.items()), last) for k, (tail, at, number, waiting, last) in kept.items()]),))
        else:
            state.remove()
        yield pd.DataFrame(rows, columns=["key", "sent_no", "sentence", "surfaces"])

    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    return chunks.select(bucket, "key", "seq", "chunk", "last").groupBy("bucket").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _surfaces(engine: Engine, sentence: str, mode: str) -> str:
    return " ".join(n.word.surface for n in engine.path_of(normalized(sentence, engine.input).text, mode))
