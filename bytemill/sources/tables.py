"""Readers: the driver's tables, whole files as binary values, and files as ordered chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.functions.buffers import scatter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of every file below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def file_chunks(spark: SparkSession, path: str, size: int, pattern: str = "*") -> DataFrame:
    """(stream, seq, chunk, last): the files cut into chunks of ``size`` bytes."""
    cut = files(spark, path, pattern).select(F.col("path").alias("stream"), scatter(F.col("content"), size).alias("chunks"))
    return cut.select("stream", F.size("chunks").alias("n"), F.posexplode("chunks").alias("seq", "chunk")).select("stream", "seq", "chunk", (F.col("seq") == F.col("n") - 1).alias("last"))
