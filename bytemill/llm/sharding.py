"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts are one group and stay in one shard, unless the group outgrows
``1 / SPLIT`` of a shard in any measure: then it is dealt by id hash into parts.
The small groups are gathered by text hash into ``buckets`` units. So the packer
sees a bounded number of vectors, whatever the number of documents, and puts
each, largest first, where its dot product with the residual capacity is highest
among all shards whose bytes it fits (where none is left, in the emptiest). Tokens
are words, counted as spaces and one. Slots are numbered inside units and
offset by the units before them, so no shard is sorted in one task.

The law is ``bytes``: shard sizes are near equal (``grown_shard`` is null). Null
text counts as no bytes and crc32 0; all null and empty texts are one group. Rows
with a null or repeated ``doc_id`` are placed like any other. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytemill.llm.common import read, stage, utf8

SHARDS = 40
OVERHEAD = 16
BUCKETS = 4096
SPLIT = 1
PART = 64
#: A shard may take a unit while it stays within this share of its equal part of all bytes.
SLACK = 0.005


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of ``loads`` (bytes, tokens, rows)."""
    total = np.maximum(loads.sum(axis=0), 1)
    vectors = loads / total * shards  # a full shard is 1 in each measure
    residual = np.ones((shards, vectors.shape[1]))
    chosen = np.zeros(len(loads), np.int64)
    for i in np.argsort(-vectors.max(axis=1), kind="stable"):
        room = residual[:, 0] - vectors[i, 0]
        fits = room >= -SLACK
        chosen[i] = int(np.argmax(np.where(fits, residual @ vectors[i], -np.inf) if fits.any() else room))
        residual[chosen[i]] -= vectors[i]
    return chosen


def shard(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            (F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("long").alias("tokens"),
            F.crc32(utf8("text")).alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
        ),
        "rows",
    )
    measures = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    total = rows.agg(*measures).first()
    if not total["r"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    # A group over 1/SPLIT of a shard: at most 3 * SPLIT * shards of them exist.
    part = F.greatest(*[F.col(c) * shards / max(1, total[c]) for c in "btr"])
    large = rows.groupBy("hash").agg(*measures).where(part > 1 / SPLIT).select("hash", F.ceil(part * PART).cast("int").alias("parts")).collect()
    first, at = [], buckets
    for hash_, parts in large:
        first.append((hash_, parts, at))
        at += parts
    split = F.broadcast(spark.createDataFrame(first, "hash long, parts int, first int"))
    unit = F.coalesce(F.col("first") + F.pmod(F.xxhash64("doc_id"), "parts"), F.pmod("hash", F.lit(buckets))).cast("int")
    dealt = rows.join(split, "hash", "left").select("doc_id", "size", "tokens", "text_crc32", unit.alias("unit"))

    loads = dealt.groupBy("unit").agg(*measures).orderBy("unit").collect()  # at most buckets + parts rows
    chosen = place(np.array([[x["b"], x["t"], x["r"]] for x in loads], float), shards)
    taken = [0] * shards
    placed = []
    for x, to in zip(loads, chosen.tolist(), strict=True):
        placed.append((x["unit"], to, taken[to]))
        taken[to] += x["r"]
    places = F.broadcast(spark.createDataFrame(placed, "unit int, shard int, before long"))
    inside = F.row_number().over(Window.partitionBy("unit").orderBy("doc_id", "text_crc32", "size"))
    return (
        dealt.withColumn("inside", inside)
        .join(places, "unit")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).alias("slot"))
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
