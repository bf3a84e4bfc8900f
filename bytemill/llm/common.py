"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: str | None = None
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only in local mode, where the session sets none, a folder of this process is made and used.
    """
    global _OWN_DIR
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="bytemill-")
    return _OWN_DIR


def _hadoop(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    The table survives the loss of any executor, and goes by ``release`` or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, system = _hadoop(spark, path)
    system.deleteOnExit(target)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        target, system = _hadoop(table.sparkSession, _PATHS.pop(table))
        system.delete(target, True)


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor`` (null id: the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def utf8(column: str) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name
