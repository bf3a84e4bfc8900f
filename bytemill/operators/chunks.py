"""Transforms of values that arrive as ordered chunks.

A stream's chunks are sorted into one partition and read batch by batch by a
running digest or compressor, so memory is one batch, however long a stream is.
Null chunks count as empty; chunks with a null place in the order come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytemill.functions.digests import ALGORITHMS
from bytemill.functions.errors import require


def _in_order(df: DataFrame, stream: str, seq: str, chunk: str) -> DataFrame:
    data = F.coalesce(F.col(chunk).cast("binary"), F.lit(b""))
    return df.select(F.col(stream), F.col(seq).alias("seq"), data.alias("chunk")).repartition(stream).sortWithinPartitions(stream, "seq", "chunk").select(stream, "chunk")


def _runs(key: pa.Array) -> Iterator[tuple[int, int]]:
    """(begin, end) of each run of equal keys, nulls being equal."""
    codes = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return zip(cuts[:-1], cuts[1:], strict=True) if len(codes) else iter(())


def _by_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, bool]]:
    """(stream as an array of one, its next chunks, whether the stream begins)."""
    last: pa.Array | None = None
    for b in batches:
        for at, to in _runs(b.column(0)):
            now = b.column(0).slice(at, 1)
            yield now, b.column(1).slice(at, to - at), last is None or not last.equals(now)
            last = now


def digest_stream(df: DataFrame, name: str, stream: str, seq: str, chunk: str) -> DataFrame:
    """(stream, n_chunks, digest): the digest of a stream's chunks taken as one message."""
    import hashlib

    require(name in ALGORITHMS, f"unknown digest {name}")
    kind = df.schema[stream].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([now[0], pa.array([now[1]], pa.int64()), pa.array([now[2].digest()], pa.binary())], [stream, "n_chunks", "digest"])

        for key, chunks, begins in _by_stream(batches):
            if begins:
                if now:
                    yield out()
                now = [key, 0, hashlib.new(name)]
            for c in chunks.to_pylist():
                now[2].update(c)
            now[1] += len(chunks)
        if now:
            yield out()

    return _in_order(df, stream, seq, chunk).mapInArrow(run, f"`{stream}` {kind}, n_chunks long, digest binary")


def compress_stream(df: DataFrame, stream: str, seq: str, chunk: str, window_bits: int = 15, level: int = 6, sync: bool = True) -> DataFrame:
    """(stream, piece, packed): the pieces, numbered from 0, of one compressed member a stream, with a sync flush after each chunk if ``sync``."""
    import zlib

    from bytemill.functions.compression import clamp_level, format_of

    format_of(window_bits)
    level = clamp_level(level)
    kind = df.schema[stream].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def out(packed: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([now[0], pa.array([now[1]], pa.int64()), pa.array([packed], pa.binary())], [stream, "piece", "packed"])

        for key, chunks, begins in _by_stream(batches):
            if begins:
                if now:
                    yield out(now[2].flush())
                now = [key, 0, zlib.compressobj(level, zlib.DEFLATED, window_bits)]
            for c in chunks.to_pylist():
                packed = now[2].compress(c) + (now[2].flush(zlib.Z_SYNC_FLUSH) if sync else b"")
                if packed:
                    yield out(packed)
                    now[1] += 1
        if now:
            yield out(now[2].flush())

    return _in_order(df, stream, seq, chunk).mapInArrow(run, f"`{stream}` {kind}, piece long, packed binary")


def decompress_stream(pieces: DataFrame, stream: str, window_bits: int = 15) -> DataFrame:
    """(stream, piece, data): what the pieces of ``compress_stream`` hold, piece by piece; a stream cut short fails."""
    import zlib

    kind = pieces.schema[stream].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def whole() -> None:
            if now and not now[2].eof:
                raise ValueError(f"stream {now[0][0].as_py()} ends before its member does")

        for key, chunks, begins in _by_stream(batches):
            if begins:
                whole()
                now = [key, 0, zlib.decompressobj(window_bits)]
            for c in chunks.to_pylist():
                yield pa.RecordBatch.from_arrays([key, pa.array([now[1]], pa.int64()), pa.array([now[2].decompress(c)], pa.binary())], [stream, "piece", "data"])
                now[1] += 1
        whole()

    return _in_order(pieces, stream, "piece", "packed").mapInArrow(run, f"`{stream}` {kind}, piece long, data binary")


def lz77(df: DataFrame, key: str, data: str, least: int = 4, window: int = 1 << 15) -> DataFrame:
    """(key, seq, literals, match_length, offset): the copies that rebuild each value, one row a sequence.

    A sequence is its literal bytes, then ``match_length`` bytes from ``offset``
    back; the last one has no match. Greedy matches of ``least`` bytes or more.
    """
    require(least >= 3, f"matches of {least} bytes")
    kind = df.schema[key].dataType.simpleString()

    def sequences(b: bytes) -> Iterator[tuple[bytes, int, int]]:
        seen: dict[bytes, int] = {}
        at = start = 0
        while at + least <= len(b):
            before = seen.get(b[at : at + least])
            seen[b[at : at + least]] = at
            if before is None or at - before > window:
                at += 1
                continue
            size = least
            while at + size < len(b) and b[before + size] == b[at + size]:
                size += 1
            yield b[start:at], size, at - before
            for i in range(at + 1, min(at + size, len(b) - least + 1)):
                seen[b[i : i + least]] = i
            at = start = at + size
        yield b[start:], 0, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if (b := batch.column(1)[k].as_py()) is None:
                    continue
                literals, sizes, offsets = zip(*sequences(b), strict=True)
                n = len(sizes)
                columns = [batch.column(0).take(pa.array([k] * n)), pa.array(range(n), pa.int32()), pa.array(literals, pa.binary()), pa.array(sizes, pa.int32()), pa.array(offsets, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [key, "seq", "literals", "match_length", "offset"])

    return df.select(key, F.col(data).cast("binary").alias("data")).mapInArrow(run, f"`{key}` {kind}, seq int, literals binary, match_length int, offset int")


def lz77_restore(sequences: DataFrame, key: str) -> DataFrame:
    """(key, data): the values that ``lz77`` took apart.

    Sequences are sorted by key and place and read batch by batch, so a task holds one batch and one value.
    """
    kind = sequences.schema[key].dataType.simpleString()
    own = sequences.select(F.col(key), "seq", "literals", "match_length", "offset")
    ordered = own.repartition(key).sortWithinPartitions(key, "seq").drop("seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data = None, bytearray()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([now, pa.array([bytes(data)], pa.binary())], [key, "data"])

        for b in batches:
            literals, sizes, offsets = (c.to_pylist() for c in b.columns[1:])
            for at, to in _runs(b.column(0)):
                first = b.column(0).slice(at, 1)
                if now is None or not now.equals(first):
                    if now is not None:
                        yield out()
                    now, data = first, bytearray()
                for k in range(at, to):
                    data += literals[k]
                    if size := sizes[k]:
                        begin = len(data) - offsets[k]
                        before = data[begin : begin + size]
                        data += (before * -(-size // len(before)))[:size]  # a copy may run into what it makes
        if now is not None:
            yield out()

    return ordered.mapInArrow(run, f"`{key}` {kind}, data binary")
