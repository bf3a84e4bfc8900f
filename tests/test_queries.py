"""Every registered query against its SQL, and the driver's three functions."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from bytemill.plans import registry
from conftest import DATA, assert_same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert_same(registry.queries()[name](spark, f"{DATA}/sf0.001"), registry.oracle_sql()[name])


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 200


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_capabilities_name_every_kind(spark):
    kinds = {r["kind"] for r in registry.queries()["capabilities"](spark, f"{DATA}/sf0.001").collect()}
    assert {"digest", "hmac", "compression", "cipher", "mac", "aead", "rsa", "dh", "curve", "checksum", "random"} <= kinds


def test_names_and_sql_need_no_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = Path(__spark_entry__.__file__).parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=60).returncode == 0
