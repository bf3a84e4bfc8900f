"""Lossless compression of binary columns: raw deflate, zlib, gzip and zstd.

``compress`` and ``decompress`` raise on bad data, ``try_decompress`` gives null,
and ``decompress_detail`` tells status, produced and consumed bytes. Null in,
null out. Rows are independent; ordered chunks are in ``operators.chunks``.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bytemill.functions.errors import require

#: Status codes of the detail struct.
OK, CORRUPT, TRUNCATED = 0, 5, 2
FORMATS = {"deflate": -15, "zlib": 15, "gzip": 31, "zstd": None}
DETAIL = "out binary, status int, produced long, consumed long"


def format_of(window_bits: int) -> tuple[str, int]:
    """The format and window a zlib windowBits value asks for: -15..-8 raw, 8..15 zlib, 24..31 gzip."""
    for name, low, base in (("deflate", -15, None), ("zlib", 8, 0), ("gzip", 24, 16)):
        if low <= window_bits <= low + 7:
            return name, -window_bits if base is None else window_bits - base
    require(False, f"window bits {window_bits}")
    raise AssertionError


def clamp_level(level: int) -> int:
    """Deflate levels: 0 and below count as 1, above 9 as 9."""
    return min(9, max(1, level))


def _bits(format: str, window: int) -> int:
    return {"deflate": -max(window, 9), "zlib": window, "gzip": window + 16}[format]


def compress(data: Column, format: str = "zlib", level: int = 6, window: int = 15) -> Column:
    require(format in FORMATS, f"unknown format {format}")
    require(9 <= window <= 15, f"window of {window} bits")
    require(format != "zstd" or -7 <= level <= 22, f"zstd level {level}")
    bits = None if format == "zstd" else _bits(format, window)
    level = level if format == "zstd" else clamp_level(level)

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        if bits is None:
            import zstandard

            packer = zstandard.ZstdCompressor(level=level)
            return column.map(lambda b: None if b is None else packer.compress(b))

        def one(b: bytes) -> bytes:
            c = zlib.compressobj(level, zlib.DEFLATED, bits)
            return c.compress(b) + c.flush()

        return column.map(lambda b: None if b is None else one(b))

    return run(data.cast("binary"))


def _restore(b: bytes, format: str) -> tuple[bytes | None, int, int]:
    """(output, status, consumed bytes); format auto: gzip by its magic, else zlib."""
    if format == "zstd":
        import zstandard

        d = zstandard.ZstdDecompressor().decompressobj()
    else:
        d = zlib.decompressobj((31 if b[:2] == b"\x1f\x8b" else 15) if format == "auto" else FORMATS[format])
    try:
        out = d.decompress(b) + (d.flush() if format != "zstd" else b"")
    except Exception as e:
        if isinstance(e, zlib.error) or type(e).__name__ == "ZstdError":
            return None, CORRUPT, 0
        raise
    if not d.eof:
        return None, TRUNCATED, len(b)
    return out, OK, len(b) - len(d.unused_data)


def _checked(format: str) -> None:
    require(format in FORMATS or format == "auto", f"unknown format {format}")


def decompress(data: Column, format: str = "auto") -> Column:
    _checked(format)

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        def one(b: bytes) -> bytes:
            out, status, _ = _restore(b, format)
            if status != OK:
                raise ValueError(f"decompression failed with status {status}")
            return out

        return column.map(lambda b: None if b is None else one(b))

    return run(data)


def try_decompress(data: Column, format: str = "auto") -> Column:
    _checked(format)

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else _restore(b, format)[0])

    return run(data)


def decompress_detail(data: Column, format: str = "auto") -> Column:
    """struct<out, status, produced, consumed>; status 0 ok, 2 truncated, 5 corrupt."""
    _checked(format)

    @F.pandas_udf(DETAIL)
    def run(column: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None, None) if b is None else ((r := _restore(b, format))[0], r[1], len(r[0] or b""), r[2]) for b in column]
        return pd.DataFrame(rows, columns=["out", "status", "produced", "consumed"]).astype({"status": "Int32", "produced": "Int64", "consumed": "Int64"})

    return F.when(data.isNotNull(), run(data))
