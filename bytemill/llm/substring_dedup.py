"""Substring dedup: every 50-word window that also starts in a document with a smaller id goes.

Automata of whole reference shards can't be broadcast at scale (their size is
that of the corpus, and every document would meet every shard), so the shards
are cut by content and each document meets only those it shares text with:

1. Each window names an anchor, the least hashed ``GRAM``-word run inside it.
   Windows in a row with the same anchor form a region. Equal windows name the
   same anchor, wherever they are.
2. Anchors met once are dropped. Equal regions are aggregated to their smallest
   document: all later documents lose the whole region.
3. What is left are different regions around one anchor: a reference shard. Its
   suffix automaton takes the regions in the order of their documents, and each
   region is first streamed through the automaton of the smaller documents;
   where the matching statistic reaches the window length the span goes.
4. A shard of more than ``SHARD`` regions (a phrase in very many contexts) is
   decided by window hashes, aggregated to the smallest document, instead.

Words are compared by 64-bit hashes (32 bits of each in the automata), so a
window counts as equal if all its hashes are. Null texts have no words. A row
with a null ``doc_id`` neither loses words nor counts as a smaller document.
Rows that share an id are not smaller than each other, and each is judged by its
own text. Nothing depends on other columns. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.llm.common import read, stage, utf8
from bytemill.llm.hashing import mix, run_hash, run_sums, word_hashes

WINDOW = 50
GRAM = 20
LONG_GRAM = 44
#: Different regions around one anchor that one automaton takes.
SHARD = 256
#: Words whose windows are looked at at once: it bounds a task's memory.
WORDS_AT_ONCE = 1 << 19


def _regions(words: np.ndarray, doc: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, region) of all regions in ``words``; doc tells the documents apart."""
    if len(words) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    sums = run_sums(words)
    at = np.arange(len(words) - gram + 1)
    grams = run_hash(sums, at, at + gram)
    place = np.uint64((1 << 20) - 1)
    least = (grams & ~place) | at.astype(np.uint64)  # ties: the first one
    span, reach = 1, WINDOW - gram + 1
    while span < reach:
        step = min(span, reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    anchor = (least & place).astype(np.int64)
    start = np.flatnonzero(doc[: len(anchor)] == doc[WINDOW - 1 :])
    if not len(start):
        return _regions(words[:0], doc[:0])
    anchor = anchor[start]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    start, anchor = start[first], anchor[first]
    region = mix(run_hash(sums, start, start + n + WINDOW - 1) + n.astype(np.uint64))
    return start, n, grams[anchor], region


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, region, doc_id, tag, start, n): each region of each document."""
    names = ["anchor", "region", "doc_id", "tag", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[int], words: list[np.ndarray], ids: np.ndarray, tags: np.ndarray, offset: int = 0):
            doc = np.repeat(np.array(rows), [len(w) for w in words])
            joined = np.concatenate(words)
            begins = np.zeros(max(rows) + 1, np.int64)
            begins[rows] = np.cumsum([0, *(len(w) for w in words[:-1])])
            start, n, anchor, region = _regions(joined, doc)
            of = doc[start]
            columns = [anchor.view(np.int64), region.view(np.int64), ids[of], tags[of], (start - begins[of] + offset).astype(np.int32), n.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for b in batches:
            ids, tags = np.asarray(b.column(0)), np.asarray(b.column(1))
            rows, words, held = [], [], 0
            for i in range(b.num_rows):
                w = word_hashes(b.column(2)[i].as_py())
                if len(w) < WINDOW:
                    continue
                if len(w) > WORDS_AT_ONCE:  # slices overlap, so that each window is in one
                    for at in range(0, len(w) - WINDOW + 1, WORDS_AT_ONCE):
                        yield out([i], [w[at : at + WORDS_AT_ONCE + WINDOW - 1]], ids, tags, at)
                    continue
                rows.append(i)
                words.append(w)
                held += len(w)
                if held >= WORDS_AT_ONCE // 2:
                    yield out(rows, words, ids, tags)
                    rows, words, held = [], [], 0
            if rows:
                yield out(rows, words, ids, tags)

    return docs.where("doc_id IS NOT NULL").select("doc_id", "tag", utf8("text").alias("text")).mapInArrow(
        run, "anchor long, region long, doc_id long, tag int, start int, n int"
    )


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            if (q := self.next[last].get(word)) is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            now, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = now

    def matched(self, words: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal spans (start, length) covered by runs of ``least`` words that the automaton knows."""
        spans: list[tuple[int, int]] = []
        at = length = 0
        for i, word in enumerate(words):
            while at and word not in self.next[at]:
                at = self.link[at]
                length = self.length[at]
            if (q := self.next[at].get(word)) is not None:
                at, length = q, length + 1
            if length >= least:
                start = i - least + 1
                if spans and start <= spans[-1][0] + spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1 - spans[-1][0])
                else:
                    spans.append((start, least))
        return spans


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (anchor, region, regions, doc_id, tag, start, n) with the region's word hashes."""
    lists = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "region", "regions", "start", "n")).alias("places"))
    joined = docs.join(lists, ["doc_id", "tag"]).select("doc_id", utf8("text").alias("text"), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = (word_hashes(b.column(1)[i].as_py()) >> np.uint64(32)).astype(np.uint32)
                places = b.column(2)[i].as_py()
                words = [words[p["start"] : p["start"] + p["n"] + WINDOW - 1].tobytes() for p in places]
                columns = [[p[k] for p in places] for k in ("anchor", "region", "regions")]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip([*columns, [b.column(0)[i].as_py()] * len(places), words], types, strict=True)],
                    ["anchor", "region", "regions", "doc_id", "words"],
                )

    return joined.mapInArrow(run, "anchor long, region long, regions long, doc_id long, words binary")


def _by_automata(contents: DataFrame) -> DataFrame:
    """(region, anchor, at, length): spans of a region that smaller documents of its shard hold."""

    def spans(group: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        automaton, waiting, doc = Automaton(), [], None
        for anchor, region, doc_id, words in group:  # rising ids
            if doc_id != doc:
                for w in waiting:
                    automaton.add(w)
                waiting, doc = [], doc_id
            found = automaton.matched(words, WINDOW)
            yield from ((anchor, region, at, length) for at, length in found)
            if found != [(0, len(words))]:
                waiting.append(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor", "region", "at", "length"])

        group: list[tuple] = []
        for b in batches:
            rows: list[tuple] = []
            for anchor, region, doc_id, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][0] != anchor:
                    rows.extend(spans(group))
                    group = []
                group.append((anchor, region, doc_id, np.frombuffer(words, np.uint32).tolist()))
            yield out(rows)
        yield out(list(spans(group)))

    rows = contents.select("anchor", "region", "doc_id", "words").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "region")
    return rows.mapInArrow(run, "anchor long, region long, at int, length int")


def _by_windows(contents: DataFrame) -> DataFrame:
    """The same for shards of any size: each window's smallest document.

    Windows are named anew by runs of ``LONG_GRAM`` words; only those whose run
    occurs elsewhere are looked at one by one.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for anchor, region, doc_id, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                values = np.frombuffer(words, np.uint32).astype(np.uint64)
                start, n, gram, _ = _regions(values, np.zeros(len(values), np.int8), LONG_GRAM)
                rows += [
                    (g, anchor, region, doc_id, at, words[4 * at : 4 * (at + k + WINDOW - 1)])
                    for g, at, k in zip(gram.view(np.int64).tolist(), start.tolist(), n.tolist(), strict=True)
                ]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            names = ["gram", "anchor", "region", "doc_id", "at", "words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for anchor, region, doc_id, first, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums = run_sums(np.frombuffer(words, np.uint32).astype(np.uint64))
                at = np.arange(len(sums) - WINDOW)
                h = run_hash(sums, at, at + WINDOW).view(np.int64)
                same = [pa.array(np.full(len(at), x, np.int64)) for x in (anchor, region, doc_id)]
                yield pa.RecordBatch.from_arrays([*same, pa.array((at + first).astype(np.int32)), pa.array(h)], ["anchor", "region", "doc_id", "at", "h"])

    named = contents.select("anchor", "region", "doc_id", "words").mapInArrow(
        runs, "gram long, anchor long, region long, doc_id long, at int, words binary"
    )
    named = stage(named, "named")
    often = stage(named.groupBy("gram").count().where("count > 1").select("gram"), "often")
    met = named.join(often, "gram").select("anchor", "region", "doc_id", "at", "words")
    met = stage(met.mapInArrow(windows, "anchor long, region long, doc_id long, at int, h long"), "windows")
    first = stage(met.groupBy("h").agg(F.min("doc_id").alias("first")), "first")
    return met.join(first, "h").where("first < doc_id").select("anchor", "region", "at", F.lit(WINDOW).alias("length"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, start, length): word spans to remove; ``docs`` has doc_id, tag and text."""
    all_regions = stage(_anchors(docs), "regions")
    # joined tables are staged first: then both sides of a join are plain shuffles, and hot keys are split
    often = stage(all_regions.groupBy("anchor").count().where("count > 1").select("anchor"), "often")
    shared = stage(all_regions.join(often, "anchor"), "shared")
    kinds = shared.groupBy("anchor", "region").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    kinds = stage(kinds, "kinds")
    shards = stage(kinds.groupBy("anchor").agg(F.count("*").alias("regions"), F.min("first").alias("least"), F.max("first").alias("most")), "shards")
    kinds = stage(kinds.join(shards, "anchor").where("rows > 1 OR (regions > 1 AND least < most)"), "kinds")
    placed = stage(shared.join(kinds, ["anchor", "region"]), "placed")
    whole = placed.where("doc_id > first").select("doc_id", "tag", "start", (F.col("n") + WINDOW - 1).alias("length"))

    own = placed.where("doc_id = first AND regions > 1 AND least < most")
    one = own.groupBy("anchor", "region", "regions").agg(F.min(F.struct("doc_id", "tag", "start", "n")).alias("p"))
    contents = stage(_contents(docs, one.select("anchor", "region", "regions", "p.*")), "contents")
    found = stage(_by_automata(contents.where(F.col("regions") <= SHARD)).union(_by_windows(contents.where(F.col("regions") > SHARD))), "found")
    part = own.join(found, ["anchor", "region"]).select("doc_id", "tag", (F.col("start") + F.col("at")).alias("start"), "length")
    return whole.union(part)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row with the words that stay, joined by one space."""
    tagged = docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(2**31 - 1)).cast("int").alias("tag"))
    spans = repeated_spans(tagged).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    joined = tagged.join(spans, ["doc_id", "tag"], "left").select("doc_id", utf8("text").alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for i in range(b.num_rows):
                words, spans = b.column(1)[i].as_py().split(), b.column(2)[i].as_py()
                total.append(len(words))
                if spans:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, [s["start"] for s in spans], 1)
                    np.add.at(gone, [s["start"] + s["length"] for s in spans], -1)
                    stays = np.cumsum(gone)[:-1] == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
