"""Digests and MACs as column expressions.

MD5, SHA-1 and SHA-2 are Spark's own functions and HMAC is composed of them, so
they stay in generated code. Digests Spark lacks go through one Arrow-batched
call of Python's hashlib. All take and give binary; null in, null out.
"""

from __future__ import annotations

import hashlib
import hmac as _hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytemill.functions.errors import require

#: name: (output bytes, block bytes)
NATIVE = {"md5": (16, 64), "sha1": (20, 64), "sha224": (28, 64), "sha256": (32, 64), "sha384": (48, 128), "sha512": (64, 128)}
LIBRARY = {"sm3": (32, 64), "sha512_224": (28, 128), "sha512_256": (32, 128)}
ALGORITHMS = NATIVE | LIBRARY


def _native(name: str, data: Column) -> Column:
    if name == "md5":
        return F.unhex(F.md5(data))
    if name == "sha1":
        return F.unhex(F.sha1(data))
    return F.unhex(F.sha2(data, int(name[3:])))


def _library(name: str, key: bytes | None = None):
    @F.pandas_udf("binary")
    def run(data: pd.Series) -> pd.Series:
        if key is None:
            return data.map(lambda b: None if b is None else hashlib.new(name, b).digest())
        return data.map(lambda b: None if b is None else _hmac.new(key, b, name).digest())

    return run


def digest(name: str, data: Column, length: int | None = None) -> Column:
    """The digest of a binary column, cut to ``length`` bytes (a positive multiple of 4)."""
    require(name in ALGORITHMS, f"unknown digest {name}")
    data = data.cast("binary")
    return _cut(name, _native(name, data) if name in NATIVE else _library(name)(data), length)


def hmac(name: str, key: bytes, data: Column, length: int | None = None) -> Column:
    """HMAC with a constant key of at most one block, a multiple of 4 bytes: longer keys are refused, not hashed."""
    require(name in ALGORITHMS, f"unknown digest {name}")
    block = ALGORITHMS[name][1]
    require(0 < len(key) <= block and len(key) % 4 == 0, f"key of {len(key)} bytes for hmac-{name}")
    data = data.cast("binary")
    if name not in NATIVE:
        return _cut(name, _library(name, key)(data), length)
    padded = key.ljust(block, b"\0")
    inner = _native(name, F.concat(F.lit(bytes(b ^ 0x36 for b in padded)), data))
    return _cut(name, _native(name, F.concat(F.lit(bytes(b ^ 0x5C for b in padded)), inner)), length)


def _cut(name: str, value: Column, length: int | None) -> Column:
    full = ALGORITHMS[name][0]
    if length is None or length == full:
        return value
    require(0 < length < full and length % 4 == 0, f"{length} bytes of {name}")
    return F.substring(value, 1, length)


@F.pandas_udf(T.LongType())
def adler32(data: pd.Series) -> pd.Series:
    """Adler-32 as an unsigned value. CRC-32 is Spark's own ``crc32``."""
    import zlib

    return data.map(lambda b: None if b is None else zlib.adler32(b)).astype("Int64")
