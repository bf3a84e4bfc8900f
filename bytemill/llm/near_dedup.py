"""Near-duplicates by SimHash fingerprints, bit-sliced; and by exact Jaccard similarity among those.

Fingerprints are made in Arrow batches and filed under keys; only the members of
one file are compared. They are compared bit-sliced: plane k holds bit k of 64
members in one machine word, carry-save counters add up 64 distances at a time,
and a word whose lanes have all passed the radius is abandoned. Links become
components by alternating large-star and small-star passes, which are DataFrame
joins.

``near_duplicates`` links 64-bit fingerprints within a small radius, without a
miss: the bits are cut into ``radius + 2`` blocks, and two fingerprints that close
agree in at least two blocks, so a file is named by a pair of blocks.

``similar`` links texts whose sets of distinct shingles have at least a given
Jaccard similarity. Fingerprints of ``64 * WIDE`` bits over the set are filed by
``BANDS`` groups of ``ROWS`` minimal hashes; links within ``wide_radius`` make
clusters. Each set is then sent once to its cluster, where pairs within the radius
are compared on the whole sets; only a pair that has the similarity is a link. Two
texts at the limit of 0.8 fail to meet with probability 0.0008, and pass the
radius but for less than 0.003 (tiny sets; others far less); the likelier the
closer. So no link is wrong, and nearly none is missed (``tests`` hold it against
brute force).

A file over ``TILE`` members is dealt into tiles, and its ``LEADERS`` are sent to
all of them; whatever is not connected to the file's largest part after that meets
every tile, ``TILE`` members at a time. So no task holds more than two tiles, and a
large group of near copies takes work in proportion to its size. Equal
fingerprints are one row from the start.

Nulls: a null text has no words, hence fingerprint zero and an empty set. A
row with a null ``doc_id`` gets a fingerprint, but ids decide the representative,
so its ``component_id`` is the smallest non-null id of its component (null if
none). Repeated rows each get their own output row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytemill.llm.common import read, release, stage, unused, utf8

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE, LEADERS = 1024, 32
#: For ``similar``: words of a shingle, 64-bit words of a fingerprint, and how files are named.
WIDE_SHINGLE, WIDE, BANDS, ROWS = 5, 4, 10, 3
#: Comparison words handled at once, which bounds a task's memory.
PAIRS_AT_ONCE = 1 << 17

_SPREAD = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], dtype=np.uint64)
_ONE = np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the minimal hashes.
_MINIMAL = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | _ONE


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each of the 64 bits set."""
    lanes = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    if rest := -len(lanes) % 255:
        lanes = np.concatenate([lanes, np.zeros((rest, 8), np.uint64)])
    sums = lanes.reshape(-1, 255, 8).sum(axis=1)  # at most 255 in a byte: no carry between lanes
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def _hashes(text: bytes, shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of one text, in parts; a shorter text is one shingle, and one without words has none."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :]
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text: majority bits over XXH64 of its word shingles."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in _hashes(text, shingle, seed):
        n += len(hashes)
        counts += _bit_counts(hashes)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, f0): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "f0"])

    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(run, "doc_id long, f0 long")


def block_masks(radius: int) -> list[int]:
    """All pairs of ``radius + 2`` blocks of 64 bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _by_masks(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(key, node, f0): each fingerprint under each mask."""
    keys = [F.xxhash64(F.lit(t), F.col("f0").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "node", "f0")


def _planes(members: np.ndarray) -> np.ndarray:
    """Bit planes of (members, words): row k, word w holds bit k of members 64w to 64w+63."""
    bits = np.unpackbits(np.ascontiguousarray(members).view(np.uint8), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((-len(members) % 64, bits.shape[1]), np.uint8)])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _near(planes: np.ndarray, word: np.ndarray, query: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the comparisons with a lane within ``radius``, and those lanes as bits."""
    at = np.arange(len(word))
    counter = [np.zeros(len(word), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(word), np.uint64)
    for k in range(0, len(planes), 2):
        q = query[:, k // 64]
        a = planes[k][word] ^ (np.uint64(0) - ((q >> np.uint64(k % 64)) & _ONE))
        b = planes[k + 1][word] ^ (np.uint64(0) - ((q >> np.uint64(k % 64 + 1)) & _ONE))
        low = counter[0]
        part = low ^ a
        carry = (low & a) | (part & b)
        counter[0] = part ^ b
        for c in counter[1:]:
            up = c & carry
            c ^= carry
            carry = up
        over |= carry
        if k % 8 == 6 and k > 2 * radius or k == len(planes) - 2:
            past, equal = over.copy(), ~np.uint64(0)  # the vertical number against the radius, from the top bit
            for i in reversed(range(len(counter))):
                if radius >> i & 1:
                    equal = equal & counter[i]
                else:
                    past |= equal & counter[i]
                    equal = equal & ~counter[i]
            live = (valid & ~past) != 0
            if k == len(planes) - 2:
                return at[live], (valid & ~past)[live]
            if live.mean() < 0.8:
                at, word, query, valid, over = (x[live] for x in (at, word, query, valid, over))
                counter = [c[live] for c in counter]
    raise AssertionError("no planes")


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union a[i] with b[i]: labels become the smallest member index of a component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (step := label[label])).any():
            label[:] = step


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0


def _verify(label: np.ndarray, a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Union a[i] with b[i] where their sets are that similar and they are not connected yet; the links made."""
    made = []
    while (label != (step := label[label])).any():
        label[:] = step
    apart = label[a] != label[b]
    for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
        x, y = i, j
        while label[x] != x:
            x = label[x]
        while label[y] != y:
            y = label[y]
        if x != y:
            n, m = len(sets[i]), len(sets[j])
            if min(n, m) >= similarity * max(n, m) - 1e-9:
                both = _overlap(sets[i], sets[j])
                if both >= similarity * (n + m - both) - 1e-9:
                    label[max(x, y)] = min(x, y)
                    made.append((i, j))
    return made


def _links(first: np.ndarray, lane: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int, sets: list[np.ndarray] | None = None, similarity: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the rows, which are whole groups with lanes first; ``first`` marks where each begins."""
    group = np.cumsum(first) - 1
    keep = np.bincount(group)[group] > 1
    if sets is not None:
        sets = [s for s, k in zip(sets, keep.tolist(), strict=True) if k]
    group, lane, node, fp = group[keep], lane[keep], node[keep], fp[keep]
    label = np.arange(len(fp))
    rows = np.flatnonzero(lane)
    made: list[tuple[int, int]] = []
    if not len(rows):
        return node[:0], node[:0]
    planes = _planes(fp[rows])
    of = group[rows]
    begin, end = np.searchsorted(of, group, "left"), np.searchsorted(of, group, "right")
    begin = np.where(lane, np.cumsum(lane), begin)  # a lane meets only the lanes after it
    some = np.flatnonzero(begin < end)
    begin, end = begin[some], end[some]
    words = (end - 1) // 64 - begin // 64 + 1
    cuts = np.concatenate([[0], np.cumsum(words)])
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PAIRS_AT_ONCE, "right")) - 1)
        n = words[at:to]
        q = np.repeat(np.arange(at, to), n)
        word = np.arange(n.sum()) - np.repeat(cuts[at:to] - cuts[at], n) + begin[q] // 64
        left = np.clip(begin[q] - 64 * word, 0, 63).astype(np.uint64)
        right = np.clip(64 * word + 64 - end[q], 0, 63).astype(np.uint64)
        valid = (~np.uint64(0) << left) & (~np.uint64(0) >> right)
        hit, lanes = _near(planes, word, fp[some[q]], valid, radius)
        for k in range(0, len(hit), 1 << 10):
            i, j = np.nonzero(np.unpackbits(lanes[k : k + (1 << 10)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = hit[k + i]
            a, b = some[q[i]], rows[64 * word[i] + j]
            if sets is None:
                _settle(label, a, b)
            else:
                made += _verify(label, a, b, sets, similarity)
        at = to
    if sets is not None:
        a, b = (np.array(x, np.int64) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return node[a], node[b]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return node[moved], node[label[moved]]


def _compared(dealt: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): spanning links of each (key, tile, part) of ``dealt`` (key, tile, part, lane, node, f0, ..., maybe whole)."""
    exact = "whole" in dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = size = 0

        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            key, tile, part, lane, node, fp, *whole = parts
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (tile[1:] != tile[:-1]) | (part[1:] != part[:-1])])
            sets = [np.frombuffer(w, np.int64) for w in whole[0]] if exact else None
            a, b = _links(first, lane, node, fp, radius, sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            key, tile, part, lane, node, *rest = columns
            fp = rest[:-1] if exact else rest
            held.append([key, tile, part, lane.astype(bool), node, np.stack(fp, axis=1).view(np.uint64), *([rest[-1]] if exact else [])])
            rows += len(key)
            size += sum(map(len, rest[-1])) if exact else 0
            if rows >= 50_000 or size >= 1 << 25:  # all groups but the last are whole
                now = [np.concatenate(x) for x in zip(*held, strict=True)]
                other = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]) | (now[2] != now[2][-1]))
                last = int(other[-1]) + 1 if len(other) else 0
                if last:
                    yield out([x[:last] for x in now])
                held, rows, size = [[x[last:] for x in now]], 0, 0
        if held:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    return dealt.repartition("key", "tile", "part").sortWithinPartitions("key", "tile", "part", F.desc("lane")).mapInArrow(run, "a long, b long")


def links(filed: DataFrame, radius: int, similarity: float = 0) -> DataFrame:
    """(a, b): nodes linked so that every two that share a key and are within ``radius`` are connected.

    ``filed`` has key, node, f0, ..., and maybe whole, the sorted set as bytes: then
    ``similarity`` is asked of the sets, too. Every task gives spanning trees, not
    all pairs.
    """
    content = [c for c in filed.columns if c != "key"]
    sizes = filed.groupBy("key").agg(F.count("*").alias("n"))
    sizes = stage(sizes.where("n > 1").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "sizes")
    tiled = filed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    small = tiled.where("tiles = 1").select("key", F.lit(0).alias("tile"), F.lit(0).alias("part"), F.lit(True).alias("lane"), *content)
    first = _compared(small, radius, similarity)
    if sizes.where("tiles > 1").isEmpty():
        return stage(first.distinct(), "links")
    large = stage(tiled.where("tiles > 1"), "large")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node", "key")))
    leaders = stage(large.select("key", "node", rank.alias("rank")).where(F.col("rank") <= LEADERS).select("key", "node"), "leaders")
    everywhere = large.join(leaders, ["key", "node"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = large.select("key", F.col("own").alias("tile"), F.lit(0).alias("part"), F.lit(True).alias("lane"), *content)
    led = everywhere.where("tile <> own").select("key", "tile", F.lit(0).alias("part"), F.lit(False).alias("lane"), *content)
    first = stage(first.union(_compared(dealt.union(led), radius, similarity)).distinct(), "links")

    roots = stage(components(first).withColumnRenamed("node", "member"), "roots")
    placed = large.select("key", "node").join(roots, F.col("node") == F.col("member"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = stage(placed, "placed")
    main = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("m")).select("key", F.col("m.root").alias("main"))
    apart = stage(placed.join(stage(main, "main"), "key").where("root <> main").select("key", "node"), "apart")
    chunks = stage(apart.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "chunks")
    lanes = large.join(chunks, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = large.join(apart, ["key", "node"]).join(chunks, "key").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int"))
    asked = asked.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rest = lanes.select("key", F.col("own").alias("tile"), "part", F.lit(True).alias("lane"), *content).union(
        asked.select("key", "tile", "part", F.lit(False).alias("lane"), *content)
    )
    return stage(first.union(_compared(rest, radius, similarity)).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b) by alternating star contractions; root is the smallest node."""
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def star(both: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
        least = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        moved = both.join(least, "a")  # of two plain shuffles: a hot star is split
        if large:
            pairs = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            pairs = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return pairs.where("a <> b").distinct(), least

    seen = None
    while True:
        before = now
        wide, least = star(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        narrow, last = star(wide.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False)
        now = stage(narrow, "edges")
        release(before, least, last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def _named(labelled: DataFrame) -> DataFrame:
    """(node, component_id) of (node, first, root): the smallest id of each component."""
    least = stage(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    return stage(labelled.join(least, "root").select("node", "component_id"), "named")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): every two fingerprints at ``radius`` or less are in one component."""
    prints = stage(fingerprints(docs, shingle).withColumn("node", F.col("f0")), "fingerprints")
    unique = stage(prints.groupBy("node").agg(F.min("doc_id").alias("first")), "unique")
    filed = _by_masks(unique.select("node", F.col("node").alias("f0")), block_masks(radius))
    roots = stage(components(links(filed, radius)).withColumnRenamed("node", "member"), "roots")
    labelled = unique.join(roots, F.col("node") == F.col("member"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = _named(stage(labelled, "labelled"))
    return prints.join(named, "node", "left").select("doc_id", F.col("f0").alias("fp"), "component_id")


def shingle_set(text: bytes, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(text, shingle)]).view(np.int64))


def wide_radius(similarity: float) -> int:
    """Bits of a wide fingerprint that two sets of that similarity may differ in: five standard deviations over what is expected."""
    share = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi
    bits = 64 * WIDE
    return min(bits - 1, ceil(bits * share + 5 * sqrt(bits * share * (1 - share))))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """Majority bits over a set of hashes and over remixes of them, as signed words."""
    out = []
    for _ in range(WIDE):
        out.append(np.packbits(2 * _bit_counts(hashes) > len(hashes), bitorder="little").view(np.int64)[0])
        hashes = (hashes ^ (hashes >> np.uint64(31))) * _MIX
        hashes ^= hashes >> np.uint64(32)
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys: two sets share a key if ``ROWS`` minimal hashes agree."""
    least = np.full(len(_MINIMAL), ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[at : at + (1 << 12)] * _MINIMAL[:, None]).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def _prints(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, node, f0, ..., bands): a hash of each text's shingle set, its wide fingerprint and its files."""
    words = [f"f{k}" for k in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            nodes, prints, bands = [], [], []
            for text in b.column(2).to_pylist():
                own = shingle_set(text, shingle)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                prints.append(wide_fingerprint(own.view(np.uint64)))
                bands.append(band_keys(own.view(np.uint64)))
            offsets = pa.array(np.arange(0, BANDS * len(nodes) + 1, BANDS, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            columns = [b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64))]
            columns += [pa.array(c) for c in np.array(prints, np.int64).reshape(-1, WIDE).T]
            yield pa.RecordBatch.from_arrays([*columns, lists], ["doc_id", "key", "node", *words, "bands"])

    schema = ", ".join(["doc_id long, key long, node long", *(f"{w} long" for w in words), "bands array<long>"])
    return stage(texts.select("doc_id", "key", "text").mapInArrow(run, schema), "prints")


def _similar_links(texts: DataFrame, prints: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): nodes linked so that all sets of at least that similarity are connected, and no others."""
    words = [f"f{k}" for k in range(WIDE)]
    radius = wide_radius(similarity)
    unique = prints.groupBy("node").agg(F.min("key").alias("key"), *[F.min(w).alias(w) for w in words], F.min("bands").alias("bands"))
    unique = stage(unique, "unique")
    filed = unique.select(F.explode("bands").alias("key"), "node", *words)
    clusters = stage(components(links(filed, radius)).withColumnRenamed("root", "cluster"), "clusters")
    # components() names all nodes but the roots
    members = clusters.union(clusters.select(F.col("cluster").alias("node"), "cluster").distinct())
    members = stage(unique.join(stage(members, "members"), "node").select("node", "key", "cluster", *words), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle).tobytes() for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.binary())], ["node", "cluster", *words, "whole"])

    schema = ", ".join(["node long, cluster long", *(f"{w} long" for w in words), "whole binary"])
    copies = texts.select(F.col("key").alias("of"), "text").join(members, F.col("of") == F.col("key"))
    one = copies.groupBy("node", "cluster", *words).agg(F.min("text").alias("text"))  # copies of a text are one row
    sets = stage(one.mapInArrow(run, schema), "sets")
    found = links(sets.select(F.col("cluster").alias("key"), "node", *words, "whole"), radius, similarity)
    release(unique, members, sets)
    return found


def _alike(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(doc_id, key, root): a hash of each row's text, and its component."""
    texts = docs.select("doc_id", F.xxhash64(utf8("text")).alias("key"), utf8("text").alias("text"))
    prints = _prints(texts, shingle)
    roots = stage(components(_similar_links(texts, prints, similarity, shingle)).withColumnRenamed("node", "member"), "roots")
    found = prints.select("doc_id", "key", "node").join(roots, F.col("node") == F.col("member"), "left")
    return stage(found.select("doc_id", "key", F.coalesce("root", "node").alias("root")), "alike")


def similar(docs: DataFrame, similarity: float = 0.8, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """(doc_id, component_id): texts whose sets of distinct shingles have that Jaccard similarity or more are in one component."""
    found = _alike(docs, similarity, shingle)
    least = stage(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return found.join(least, "root").select("doc_id", "component_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of each component stays: the one with the smallest id (of rows that repeat it and its text, any one; null ids come last)."""
    found = _alike(docs, similarity, WIDE_SHINGLE)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("kept")).select("kept.*")
    kept = stage(kept.select("doc_id", "key"), "kept").alias("k")
    own = unused(docs.columns, "key")
    keyed = docs.withColumn(own, F.xxhash64(utf8("text"))).alias("d")
    stays = keyed.join(kept, (F.col(f"d.{own}") == F.col("k.key")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
    return stays.dropDuplicates(["doc_id", own]).drop(own)
