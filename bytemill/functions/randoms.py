"""Random bytes: reproducible ones from a seed and a row key, and fresh ones."""

from __future__ import annotations

import secrets

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bytemill.functions.errors import require


def seeded_bytes(seed: int, row: Column, size: int) -> Column:
    """``size`` bytes that seed and row fix: SHA-256 over seed, row and a counter, in built-in functions."""
    require(size > 0, f"{size} random bytes")
    block = F.transform(F.sequence(F.lit(0), F.lit((size - 1) // 32)), lambda i: F.sha2(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), i.cast("string")).cast("binary"), 256))
    return F.when(row.isNotNull(), F.substring(F.unhex(F.array_join(block, "")), 1, size))


def fresh_bytes(row: Column, size: int) -> Column:
    """``size`` bytes of the system's generator for each row; no two runs agree."""
    require(size > 0, f"{size} random bytes")

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda _: secrets.token_bytes(size))

    return run.asNondeterministic()(row)
