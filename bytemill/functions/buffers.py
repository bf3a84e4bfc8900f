"""Scatter-gather buffers as arrays of binary chunks, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytemill.functions.errors import require


def gather(chunks: Column) -> Column:
    """All chunks as one binary value, joined once; null chunks count as empty."""
    return F.unhex(F.array_join(F.transform(chunks, lambda c: F.coalesce(F.hex(c), F.lit(""))), ""))


def scatter(data: Column, size: int) -> Column:
    """Chunks of ``size`` bytes, the last one shorter; empty data gives no chunk."""
    require(size > 0, f"chunks of {size} bytes")
    n = F.ceil(F.octet_length(data) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(data, (i - 1) * size + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.when(data.isNotNull(), F.array().cast("array<binary>")))


def merge(left: Column, right: Column) -> Column:
    return F.concat(left, right)


def total_bytes(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda a, c: a + F.coalesce(F.octet_length(c), F.lit(0)))


def holds(chunks: Column, wanted: Column) -> Column:
    """Whether the chunks hold at least ``wanted`` bytes."""
    return total_bytes(chunks) >= wanted


def cut(chunks: Column, offset: int, length: int) -> Column:
    """``length`` bytes from ``offset`` on over chunk bounds; fewer past the end."""
    require(offset >= 0 and length > 0, f"{length} bytes at {offset}")
    return F.substring(gather(chunks), offset + 1, length)


def xor16(a: Column, b: Column) -> Column:
    """XOR of two 16-byte values."""

    def half(x: Column, at: int) -> Column:
        # two 32-bit numbers a half, so that no value leaves the range of a signed long
        return F.conv(F.hex(F.substring(x, at, 4)), 16, 10).cast("long")

    parts = [F.lpad(F.hex(half(a, at).bitwiseXOR(half(b, at))), 8, "0") for at in (1, 5, 9, 13)]
    return F.unhex(F.concat(*parts))
