"""One local session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", "/tmp/bytemill-warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(value):
    if isinstance(value, bytearray):
        return bytes(value)
    return round(value, 6) if isinstance(value, float) and math.isfinite(value) else value


def rows(columns: list[str], values) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([_plain(row[i]) for i in order]) for row in values)


def assert_same(found: DataFrame, sql: str, sf: str = "sf0.001") -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
    wanted = con.execute(sql)
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(found.columns)
    assert rows(found.columns, found.collect()) == rows(names, wanted.fetchall())
