"""Digests of chunked values over a stream: a value is finished by its chunk marked ``last``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "stream string, n_chunks int, digest binary"
STATE = "seqs array<int>, chunks array<binary>, total int"


def digest_chunks(chunks: DataFrame, name: str = "sha256", patience_ms: int | None = None) -> DataFrame:
    """(stream, n_chunks, digest) as soon as all chunks 0..last of a stream are there, in whatever order they came.

    ``chunks`` has stream, seq, chunk and last. Chunks that repeat a seq count once
    (the later one), a null chunk is empty, a null ``last`` is false, and rows with a
    null stream or seq are left out. With ``patience_ms``, a stream that gets no chunk
    for so long (processing time) before it is whole gives its number of chunks and
    a null digest, and its state goes; without, it is waited for.
    """
    import hashlib

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, parts, total = state.get if state.exists else ([], [], -1)
        held = dict(zip(seqs, parts, strict=True))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"stream": [key[0]], "n_chunks": [len(held)], "digest": [None]})
            return
        for frame in frames:
            for seq, chunk, last in zip(frame["seq"], frame["chunk"], frame["last"], strict=True):
                held[int(seq)] = b"" if chunk is None else chunk
                if last is not None and last:
                    total = int(seq) + 1
        if total >= 0 and all(k in held for k in range(total)):
            state.remove()
            h = hashlib.new(name)
            for k in range(total):
                h.update(held[k])
            yield pd.DataFrame({"stream": [key[0]], "n_chunks": [total], "digest": [h.digest()]})
        else:
            state.update((list(held), list(held.values()), total))
            if patience_ms is not None:
                state.setTimeoutDuration(patience_ms)

    timeout = GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    known = chunks.where("stream IS NOT NULL AND seq IS NOT NULL")
    return known.groupBy("stream").applyInPandasWithState(step, RESULT, STATE, "append", timeout)
