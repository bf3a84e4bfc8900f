"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A text's words (lower case, split at ASCII white space) are hashed once. A mask
picks some words of a span and ignores the others, so a seed survives a
substituted word at an ignored place. Seeds of documents meet those of the
benchmark in one hash join, each hit names an alignment, and an alignment counts
if ``WINDOW`` aligned words in a row hold at least ``SHARE`` equal ones. Two masks of
eight words find every such window: no two substitutions among thirteen words can
spoil all their seeds (found by trying all of them).

An item shorter than the window has to match as a whole, in the same share of its
words. It is cut into one part more than words may differ, and each part is a
mask, so one of them survives. Documents get seeds for such lengths only if the
benchmark has an item of them. Items without words match nothing.

The benchmark's seeds are broadcast while they hold ``BROADCAST_BYTES`` at most,
and joined by shuffle beyond; so are the candidate documents and the items' words.
Null texts have no words. Rows with a null ``doc_id`` or a repeated one are judged
by their own text. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.llm.common import read, stage

MASKS = ((0, 2, 5, 6, 7), (0, 3, 4, 5, 7))
WINDOW = 13
SHARE = 0.8
BROADCAST_BYTES = 1 << 26
_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _SPACE), "")


def _bind(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once: as a lambda's variable the optimizer can't copy it into inner loops."""
    return F.transform(F.array(value), of)[0]


def masks(n: int, window: int = WINDOW, share: float = SHARE) -> list[tuple[int, tuple[int, ...]]]:
    """(offset, places after it) of the words that each mask keeps, for ``n`` aligned words."""
    if (n, window, share) == (WINDOW, WINDOW, SHARE):
        return [(0, m) for m in MASKS]
    parts = n - ceil(n * share - 1e-9) + 1
    edges = [n * k // parts for k in range(parts + 1)]
    return [(a, tuple(range(b - a))) for a, b in zip(edges, edges[1:], strict=False)]


def _seeds(hashed: Column, lengths: list[int], window: int, share: float) -> Column:
    """(seed, at) of every place of an array of word hashes under the masks of ``lengths``; at: where the aligned words begin."""

    def under(n: int, k: int, offset: int, places: tuple[int, ...]) -> Column:
        last = F.size(hashed) - places[-1] - 1

        def one(i: Column) -> Column:
            return F.struct(F.xxhash64(F.lit(n), F.lit(k), *[F.get(hashed, i + o) for o in places]).alias("seed"), (i - offset).alias("at"))

        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<struct<seed:bigint,at:int>>"))

    return F.concat(*[under(n, k, *m) for n in lengths for k, m in enumerate(masks(n, window, share))])


def _positions(table: DataFrame, lengths: list[int], window: int, share: float, *keys: str) -> DataFrame:
    """(keys, seed, at): a row a seed and position."""
    placed = _bind(F.transform(_words("text"), lambda w: F.xxhash64(w)), lambda h: _seeds(h, lengths, window, share))
    return table.select(*keys, F.explode(placed).alias("s")).select(*keys, "s.seed", "s.at")


def _bounded(df: DataFrame, width: Column) -> DataFrame:
    """A hint to broadcast ``df``, a staged table, if its rows of ``width`` bytes are few enough."""
    held = df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, aligned): documents that hold a passage of an item.

    ``matched`` is the largest number of equal words among ``aligned`` aligned ones.
    """
    words = stage(items.where(F.col("item_id").isNotNull()).select("item_id", "text", _words("text").alias("iw")).where(F.size("iw") > 0).distinct(), "items")
    aligned = F.least(F.size("iw"), F.lit(window))
    lengths = sorted(r["n"] for r in words.select(aligned.alias("n")).distinct().collect())  # at most ``window`` rows
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    if not lengths:
        nothing = keyed.select("doc_id", "text_hash").limit(0)
        return nothing.select("doc_id", "text_hash", F.lit(0).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("matched"), F.lit(0).alias("aligned"))
    seeds = [_positions(words.where(aligned == n), [n], window, share, "item_id").where("at = 0" if n < window else "at >= 0") for n in lengths]
    wanted = stage(reduce(DataFrame.union, seeds).select("seed", "item_id", F.col("at").alias("item_at")).distinct(), "seeds")
    hits = (
        _positions(keyed, lengths, window, share, "doc_id", "text_hash")
        .join(_bounded(wanted, F.lit(32)), "seed")
        .select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    hits = stage(hits, "hits")
    texts = keyed.alias("d").join(
        _bounded(hits, F.lit(40)).alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_hash") == F.col("h.text_hash"))
    )
    sides = texts.select("d.doc_id", "d.text_hash", "h.item_id", "h.shift", _words("d.text").alias("dw")).join(
        _bounded(words.select("item_id", "iw"), F.lit(16) + F.aggregate("iw", F.lit(0), lambda a, w: a + F.octet_length(w) + 24)), "item_id"
    )

    def equal(d: Column, w: Column) -> Column:  # word j of the item stands against word shift + j of the document
        at = F.col("shift")
        return F.transform(w, lambda x, j: F.when((j + at >= 0) & (F.get(d, F.greatest(j + at, F.lit(0))) == x), 1).otherwise(0))

    def most(eq: Column) -> Column:
        long = F.least(F.size(eq), F.lit(window))
        sums = F.transform(F.sequence(F.lit(1), F.size(eq) - long + 1), lambda s: F.aggregate(F.slice(eq, s, long), F.lit(0), lambda a, x: a + x))
        return F.struct(F.array_max(sums).alias("matched"), long.alias("aligned"))

    best = _bind(F.col("dw"), lambda d: _bind(F.col("iw"), lambda w: _bind(equal(d, w), most)))
    compared = sides.select("doc_id", "text_hash", "item_id", best.alias("best")).select("doc_id", "text_hash", "item_id", "best.*")
    return (
        compared.where(F.col("matched") >= F.ceil(F.col("aligned") * share))
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max("matched").alias("matched"), F.max("aligned").alias("aligned"))
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: doc_id, item_id and the best match."""
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("aligned").cast("long").alias("aligned"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``items``."""
    found = stage(leaks(docs, items).select("doc_id", "text_hash").distinct(), "leaks")
    leaked = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.xxhash64("d.text") == F.col("l.text_hash"))
    return docs.alias("d").join(_bounded(found, F.lit(24)).alias("l"), leaked, "left_anti")


#: All alignments with an equal word are counted; no seeds.
OP5_SQL = """
WITH iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
ip AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM iw),
dp AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM dw),
pair AS (SELECT doc_id, item_id, n, i - j AS shift, j FROM dp JOIN ip USING (word)),
runs AS (
  SELECT doc_id, item_id, n,
    count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS equal
  FROM pair)
SELECT doc_id, item_id, CAST(max(equal) AS BIGINT) AS matched, CAST(least(max(n), 13) AS BIGINT) AS aligned
FROM runs GROUP BY doc_id, item_id HAVING max(equal) >= ceil(least(max(n), 13) * 0.8)
"""
