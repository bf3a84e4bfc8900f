"""Language-model scores by online logistic context mixing.

What is gathered from the training documents, all of them:

- exact counts of every token (64-bit hashes of lower-case words);
- a memory of passages: texts are cut where two words' hash says so, about every
  ``CHUNK`` words, and each chunk is filed under the ``ORDER`` words before it. It
  grows with the corpus, and documents meet it by shuffle joins;
- counts of binary decisions in two tables of ``2 ** BITS`` slots, which are
  broadcast: a bound that the input doesn't move.

A token is coded by binary decisions. Where the memory foretells it, the first one
is whether that comes true; its probability follows how often it did so far in the
document and failed in this chunk. Otherwise the decisions are the token's path in
a weight-balanced tree over the ``HEAD`` commonest tokens (one leaf stands for all
others; such a token then has its smoothed share of them). The first ``LEVELS`` of
a path are predicted by hashed contexts (the last common word, the last token) and
by the tree's own odds, which a logistic mixer combines; what is below follows the
odds. The mixer's weights are chosen by gates (how much a context has seen, and
the depth), fitted on all decisions of all training documents, each with its own
count left out (counted by cells of rounded predictions: their number is a bound
that the input doesn't move), and refined online inside each document, ``SLICE`` tokens at a time. All predictions use only what precedes, so
the probabilities of all texts add up to at most 1. A training document never
meets its own entry of the memory.

Null text counts as empty: its one token is the end. Documents with a null id
count as id ''. Repeated rows are counted and scored each. With nothing to learn
from all scores are those of an empty count (base 0). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.llm.common import id_remainder, read, release, stage, utf8
from bytemill.llm.hashing import mix, parts, run_hash, run_sums, texts_hashes

HEAD = 1 << 17
LEVELS = 8
BITS = 20
COMMON = 64
GATES = 8
STEPS = 16
#: First bits of a hash by which a token of the head is looked up.
BUCKETS = 19
#: How finely predictions are told apart when the weights are fitted: steps a log odd and how many, of contexts and of the tree.
FINE, CONTEXT_BINS, TREE_BINS = 2, 16, 9
SLICE = 64
#: The memory: words before a chunk, about and at most how many it has.
ORDER, CHUNK, LONGEST = 6, 32, 64
#: Tokens counted, documents scored and table slots summed at once.
COUNTED, SIDE_BY_SIDE, SEGMENT = 1 << 21, 128, 1 << 16
BYTES_AT_ONCE = 1 << 20
RATE = 0.02
SMOOTH = 0.1
END = np.uint64(1)
CONTEXTS = 2
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case (A-Z only) and an end after each text, and the number of tokens a text."""
    words, sizes = texts_hashes([t.lower() for t in texts])
    found = np.full(len(words) + len(sizes), END)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(found), bool)
    inside[ends] = False
    found[inside] = words
    return found, sizes + 1


def _lists(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of 32-bit values as binaries."""
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    offsets = np.concatenate([[0], np.cumsum(size * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values[at].astype("<u4").tobytes())])


def chunks(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start in it, size, key, next) of every chunk of the tokens; the first ``ORDER`` tokens are in none."""
    ends = np.cumsum(sizes)
    begin = ends - sizes
    cut = np.zeros(len(found) + 1, bool)
    cut[2:-1] = mix(found[:-2] + found[1:-1] * np.uint64(3))[: max(0, len(found) - 2)] & np.uint64(CHUNK - 1) == 0 if len(found) > 2 else False
    for k in range(ORDER):
        cut[begin[sizes > k] + k] = False
    cut[(begin + ORDER)[sizes > ORDER]] = True
    at = np.flatnonzero(cut[:-1])
    doc = np.searchsorted(ends, at, "right")
    stop = np.minimum(np.append(at[1:], len(found)), ends[doc])
    n = -(-(stop - at) // LONGEST)  # long chunks are cut again
    again = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, stop, doc = np.repeat(at, n) + again * LONGEST, np.repeat(stop, n), np.repeat(doc, n)
    size = np.minimum(stop - at, LONGEST)
    sums = run_sums(found)
    return doc, at - begin[doc], size, run_hash(sums, at - ORDER, at), run_hash(sums, at, at + size), at


def _gathered(docs: DataFrame) -> DataFrame:
    """Token counts (token, c) of the training rows, summed by task, and all chunks (key, next, words, doc, at, learn)."""
    names = ["token", "c", "key", "next", "words", "doc", "at", "learn"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        held = 0

        def row(**columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in zip(names, types, strict=True)], names)

        def counted() -> pa.RecordBatch:
            token, c = np.unique(np.concatenate(seen), return_counts=True)
            return row(token=pa.array(token.view(np.int64)), c=pa.array(c))

        for b in batches:
            ids, learnt, texts = np.asarray(b.column(0)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            for a, z in parts([len(t) for t in texts], BYTES_AT_ONCE):
                found, sizes = tokens(texts[a:z])
                doc, at, size, key, follow, place = chunks(found, sizes)
                if len(doc):
                    words = _lists((found >> np.uint64(32)).astype(np.uint32), place, size)
                    yield row(key=pa.array(key.view(np.int64)), next=pa.array(follow.view(np.int64)), words=words, doc=pa.array(ids[a:z][doc]), at=pa.array(at.astype(np.int32)), learn=pa.array(learnt[a:z][doc]))
                own = found[np.repeat(learnt[a:z], sizes)]
                seen.append(own)
                held += len(own)
                if held >= COUNTED:
                    yield counted()
                    seen, held = [], 0
        if held:
            yield counted()

    schema = "token long, c long, key long, next long, words binary, doc long, at int, learn boolean"
    return docs.select("doc", "learn", "text").mapInArrow(run, schema)


def _foretold(rows: DataFrame) -> DataFrame:
    """(doc, told): what the memory of training documents foretells in each document, a list of (at, words).

    The commonest chunk after the same words, unless it is the document's own only.
    """
    often = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("learn").alias("c")).where("n > 1 AND c > 0").select("key")
    repeated = stage(rows.join(stage(often, "often"), "key"), "repeated")
    counts = repeated.where("learn").groupBy("key", "next").agg(F.count("*").alias("c"))
    best = counts.groupBy("key").agg(F.max(F.struct("c", "next")).alias("b")).select("key", "b.*")
    words = repeated.where("learn").select("key", "next", "words").groupBy("key", "next").agg(F.first("words").alias("told"))
    best = stage(best.join(words, ["key", "next"]).withColumnRenamed("next", "likely"), "memory")
    met = repeated.select("key", "next", "doc", "at", "learn").join(best, "key").where("NOT learn OR next <> likely OR c > 1")
    return met.groupBy("doc").agg(F.collect_set(F.struct("at", "told")).alias("told"))


@dataclass
class Tree:
    """The head tokens (sorted hashes) with their paths; index ``len(head)`` is the leaf of all others."""

    head: np.ndarray
    counts: np.ndarray
    nodes: np.ndarray  # (tokens, LEVELS): 0 past the end of a path
    bits: np.ndarray
    odds: np.ndarray  # by node: stretch of the share that goes right
    below: np.ndarray  # by token: log of its share below the last level
    common: np.ndarray  # by token: its place among the commonest, or COMMON
    buckets: np.ndarray  # by the first bits of a hash: one of the tokens that begin so

    def index(self, found: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return np.zeros(len(found), np.int64)
        at = self.buckets[(found >> np.uint64(64 - BUCKETS)).view(np.int64)]
        other = np.flatnonzero(self.head[at] != found)
        rest = np.minimum(np.searchsorted(self.head, found[other]), len(self.head) - 1)
        at[other] = np.where(self.head[rest] == found[other], rest, len(self.head))
        return at


def build_tree(head: np.ndarray, counts: np.ndarray, rare: int) -> Tree:
    order = np.argsort(head)
    head, counts = head[order], counts[order]
    weights = np.append(counts, max(rare, 1)).astype(float)
    edge = np.concatenate([[0.0], np.cumsum(weights)])
    leaves = len(weights)
    odds = np.zeros(leaves + 1, np.float32)
    nodes, bits = np.zeros((leaves, LEVELS), np.int32), np.zeros((leaves, LEVELS), np.int8)
    lo, hi = np.zeros(leaves, np.int64), np.full(leaves, leaves)
    at = np.arange(leaves)
    for level in range(LEVELS):
        open_ = np.flatnonzero(hi - lo > 1)
        if not len(open_):
            break
        a, b = lo[open_], hi[open_]
        middle = np.clip(np.searchsorted(edge, (edge[a] + edge[b]) / 2), a + 1, b - 1)  # a split is named by its first leaf on the right
        right = at[open_] >= middle
        odds[middle] = np.log((edge[b] - edge[middle]) / (edge[middle] - edge[a]))
        nodes[open_, level], bits[open_, level] = middle, right
        lo[open_[right]], hi[open_[~right]] = middle[right], middle[~right]
    common = np.full(leaves, COMMON)
    top = np.argsort(-counts, kind="stable")[:COMMON]
    common[top] = np.arange(len(top))
    buckets = np.zeros(1 << BUCKETS, np.int64)
    buckets[(head >> np.uint64(64 - BUCKETS)).view(np.int64)] = np.arange(len(head))
    return Tree(head, counts, nodes, bits, odds, np.log(weights / (edge[hi] - edge[lo])), common, buckets)


def _contexts(ids: np.ndarray, first: np.ndarray, tree: Tree) -> np.ndarray:
    """(CONTEXTS, tokens): the last common word and the last token before each; first: index of its document's first token."""
    at = np.arange(len(ids))
    last = np.empty_like(ids)
    last[1:] = ids[:-1]
    last[at == first] = len(tree.head) + 1
    rank = tree.common[ids]
    seen = np.empty_like(ids)
    seen[0], seen[1:] = -1, np.maximum.accumulate(np.where(rank < COMMON, at, -1))[:-1]
    return np.stack([np.where(seen >= first, rank[seen], COMMON), last])


def _hash(k: int, context: np.ndarray) -> np.ndarray:
    return (np.atleast_1d(context).astype(np.uint32) + np.uint32(k + 1)) * _ODD[k]


def _slots(context: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """``context`` by token, ``hashed`` nodes by level and token."""
    h = context ^ hashed
    h *= _ODD[2]
    h ^= h >> np.uint32(15)
    h *= _ODD[3]
    h >>= np.uint32(32 - BITS)
    return h.astype(np.intp)


def _hashed(nodes: np.ndarray) -> np.ndarray:
    return nodes.astype(np.uint32) * _ODD[1]


def _by_level(packed: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The tokens' rows of ``packed``, one column a token: long runs are what numpy is fast at."""
    return np.ascontiguousarray(packed.take(token, axis=0).T)


SEGMENTS = "segment int, part int, counts binary"


def _whole_segments(size: int) -> int:
    return -(-size // SEGMENT) * SEGMENT


def _segment(segment: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
    blob = pa.compress(counts.tobytes(), codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["segment", "part", "counts"])


def _segments(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counts in segments, those that hold any."""
    part = TaskContext.get().partitionId() % 16
    for segment in range(len(counts) // SEGMENT):
        own = counts[segment * SEGMENT : (segment + 1) * SEGMENT]
        if own.any():
            yield _segment(segment, part, own.astype(np.int64))


def _summed(partial: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' ``SEGMENTS``."""

    def total(keep_part: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, counts = None, None
            for b in batches:
                for segment, part, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    here = (segment, part if keep_part else 0)
                    if now != here:
                        if now is not None:
                            yield _segment(*now, counts)
                        now, counts = here, np.zeros(SEGMENT, np.int64)
                    counts += np.frombuffer(pa.decompress(blob, SEGMENT * 8, codec="zstd", asbytes=True), np.int64)
            if now is not None:
                yield _segment(*now, counts)

        return run

    by_part = partial.repartition("segment", "part").sortWithinPartitions("segment", "part").mapInArrow(total(True), SEGMENTS)
    whole = by_part.repartition("segment").sortWithinPartitions("segment").mapInArrow(total(False), SEGMENTS)
    counts = np.zeros(size, np.int64)
    for r in whole.collect():
        counts[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(pa.decompress(bytes(r["counts"]), SEGMENT * 8, codec="zstd", asbytes=True), np.int64)
    return counts


def _count_contexts(docs: DataFrame, tree: Tree) -> np.ndarray:
    """(CONTEXTS, slots, 2): how often each slot saw a 0 and a 1, over all rows of ``docs``; 64-bit sums.

    What follows the few common words is counted by token, and its decisions are
    added up at the end.
    """
    leaves = len(tree.nodes)
    slots = 1 << (BITS + 1)
    size = _whole_segments(slots + (COMMON + 1) * leaves)
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        counts, done = np.zeros(size, np.int32), 0
        packed = np.concatenate([_hashed(tree.nodes), tree.bits.astype(np.uint32), (tree.nodes > 0).astype(np.uint32)], axis=1)
        for b in batches:
            texts = b.column(0).to_pylist()
            for a, z in parts([len(t) for t in texts], BYTES_AT_ONCE):
                found, sizes = tokens(texts[a:z])
                ids = tree.index(found)
                word, last = _contexts(ids, np.repeat(np.cumsum(sizes) - sizes, sizes), tree)
                np.add.at(counts, slots + word * leaves + ids, np.int32(1))
                last = _hash(1, last)
                for at in range(0, len(ids), 1 << 12):
                    hashed, bits, some = np.split(_by_level(packed, ids[at : at + (1 << 12)]), 3)
                    place = _slots(last[at : at + (1 << 12)], hashed) * 2 + bits.view(np.int32)
                    np.add.at(counts, place[some.view(np.int32) > 0], np.int32(1))
                done += len(ids)
                if done >= 1 << 30:  # before a 32-bit count could run over
                    yield from _segments(counts)
                    counts[:], done = 0, 0
        yield from _segments(counts)

    counts = _summed(docs.select("text").mapInArrow(run, SEGMENTS), size)
    by_word = np.zeros(slots, np.int64)
    hashed = _hashed(tree.nodes)
    for word, n in enumerate(counts[slots : slots + (COMMON + 1) * leaves].reshape(-1, leaves)):
        at = np.flatnonzero(n)
        place = _slots(_hash(0, np.array(word)), hashed[at]) * 2 + tree.bits[at]
        some = tree.nodes[at] > 0
        np.add.at(by_word, place[some], np.broadcast_to(n[at, None], place.shape)[some])
    return np.stack([by_word, counts[:slots]]).reshape(CONTEXTS, -1, 2)


def _stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of a one."""
    return np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)


def _gate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """How much a context has seen, in ``GATES`` steps."""
    return np.minimum(np.ceil(np.log2(zeros + ones + 1)), GATES - 1).astype(np.intp)


@dataclass
class Mixer:
    tree: Tree
    odds: np.ndarray  # (tokens, LEVELS): the tree's own prediction, weighted
    sign: np.ndarray  # (tokens, LEVELS): against the bit that comes; 0 past the end of a path
    table: np.ndarray  # (CONTEXTS, slots): each context's prediction, weighted, in 1 / STEPS

    def score(self, ids: np.ndarray, sizes: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Natural log probability of the paths of each document's tokens; only those that are ``asked`` count."""
        total = np.zeros(len(sizes))
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        contexts = [_hash(k, c) for k, c in enumerate(_contexts(ids, np.repeat(starts, sizes), self.tree))]
        packed = np.concatenate([_hashed(self.tree.nodes), self.odds.view(np.uint32), self.sign.view(np.uint32)], axis=1)
        length = np.count_nonzero(self.sign, axis=1)
        rest = self.tree.below + (LEVELS - length) * np.log(2)  # a level that isn't there counts as a coin below
        for group in range(0, len(sizes), SIDE_BY_SIDE):
            rows = order[group : group + SIDE_BY_SIDE]
            own = np.ones((CONTEXTS + 1, len(rows)), np.float32)  # what this document has taught: a factor for each predictor
            for begin in range(0, int(sizes[rows].max(initial=0)), SLICE):
                live = np.flatnonzero(sizes[rows] > begin)
                n = np.minimum(sizes[rows[live]] - begin, SLICE)
                of = np.repeat(np.arange(len(live)), n)
                pick = np.arange(n.sum()) + np.repeat(starts[rows[live]] + begin - (np.cumsum(n) - n), n)
                keep = asked[pick]
                if not keep.all():
                    pick, of = pick[keep], of[keep]
                if not len(pick):
                    continue
                token = ids[pick]
                hashed, odds, sign = np.split(_by_level(packed, token), 3)
                sign = sign.view(np.float32)
                x = [odds.view(np.float32)] + [table.take(_slots(c[pick], hashed)) * np.float32(1 / STEPS) for table, c in zip(self.table, contexts, strict=True)]
                teach = own[:, live][:, of]
                miss = x[0] * teach[0]
                for k in range(1, CONTEXTS + 1):
                    miss += x[k] * teach[k]
                miss *= sign
                np.exp(np.minimum(miss, 30, out=miss), out=miss)  # odds against the bit that came
                more = miss + np.float32(1)
                total[rows[live]] += np.bincount(of, rest[token] - np.log(more).sum(axis=0), len(live))
                miss /= more
                miss *= sign
                made = RATE / np.sqrt(np.maximum(np.bincount(of, length[token], len(live)), 1))
                for k in range(CONTEXTS + 1):
                    own[k, live] -= made * np.bincount(of, (miss * x[k]).sum(axis=0), len(live))
        return total


CODES = GATES * CONTEXT_BINS
CELLS = LEVELS * TREE_BINS * CODES * CODES * 2


def _binned(x: np.ndarray, bins: int) -> np.ndarray:
    return np.clip(np.rint(x * FINE), -(bins // 2), (bins - 1) // 2).astype(np.int32) + bins // 2


def _left_out(counts: np.ndarray) -> np.ndarray:
    """(CONTEXTS, slots * 2): gate and rounded prediction of each slot for a decision of either bit, its own count left out."""
    found = np.empty((CONTEXTS, counts.shape[1], 2), np.uint8)
    for k, c in enumerate(counts):
        for bit in (0, 1):
            zeros, ones = np.maximum(c[:, 0] - (bit == 0), 0), np.maximum(c[:, 1] - (bit == 1), 0)
            found[k, :, bit] = _gate(zeros, ones) * CONTEXT_BINS + _binned(_stretch(zeros, ones), CONTEXT_BINS)
    return found.reshape(CONTEXTS, -1)


def _packed_cells(tree: Tree) -> np.ndarray:
    """By token and level: hashed nodes, bits, the first of the tree's cells, and whether the path goes on."""
    first = (np.arange(LEVELS) * TREE_BINS + _binned(tree.odds[tree.nodes], TREE_BINS)) * (CODES * CODES * 2) + tree.bits
    return np.concatenate([_hashed(tree.nodes), tree.bits.astype(np.uint32), first.astype(np.uint32), (tree.nodes > 0).astype(np.uint32)], axis=1)


def _add_cells(cells: np.ndarray, tree: Tree, packed: np.ndarray, codes: np.ndarray, texts: list[bytes]) -> int:
    """Count the decisions of ``texts`` by depth, rounded predictions, gates and bit; the number of tokens."""
    found, sizes = tokens(texts)
    ids = tree.index(found)
    contexts = [_hash(k, c) for k, c in enumerate(_contexts(ids, np.repeat(np.cumsum(sizes) - sizes, sizes), tree))]
    for at in range(0, len(ids), 1 << 12):
        hashed, bits, first, some = np.split(_by_level(packed, ids[at : at + (1 << 12)]), 4)
        bits = bits.view(np.int32)
        word, last = (code.take(_slots(c[at : at + (1 << 12)], hashed) * 2 + bits).astype(np.int32) for code, c in zip(codes, contexts, strict=True))
        np.add.at(cells, (first.view(np.int32) + (word * CODES + last) * 2)[some > 0], cells.dtype.type(1))
    return len(ids)


def _count_cells(docs: DataFrame, tree: Tree, counts: np.ndarray) -> np.ndarray:
    """The cells of all decisions of all rows of ``docs``."""
    size = _whole_segments(CELLS)
    shared = docs.sparkSession.sparkContext.broadcast((tree, _left_out(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, codes = shared.value
        packed, cells, done = _packed_cells(tree), np.zeros(size, np.int32), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for a, z in parts([len(t) for t in texts], BYTES_AT_ONCE):
                done += _add_cells(cells, tree, packed, codes, texts[a:z])
                if done >= 1 << 30:  # before a 32-bit count could run over
                    yield from _segments(cells)
                    cells[:], done = 0, 0
        yield from _segments(cells)

    return _summed(docs.select("text").mapInArrow(run, SEGMENTS), size)


def fit_weights(cells: np.ndarray) -> np.ndarray:
    """(CONTEXTS + 1, gates or depths): the likeliest weights given all cells, by damped Newton steps; where none were seen 0.3."""
    width = max(GATES, LEVELS)
    at = np.flatnonzero(cells)
    n, (level, tree, word, last, bit) = cells[at].astype(float), np.unravel_index(at, (LEVELS, TREE_BINS, CODES, CODES, 2))
    x = np.stack([tree - TREE_BINS // 2, word % CONTEXT_BINS - CONTEXT_BINS // 2, last % CONTEXT_BINS - CONTEXT_BINS // 2]) / FINE
    place = np.stack([level, width + word // CONTEXT_BINS, 2 * width + last // CONTEXT_BINS])
    size = (CONTEXTS + 1) * width
    start = np.full(size, 0.3)

    def loss(w: np.ndarray) -> float:
        z = (w[place] * x).sum(axis=0)
        return float((n * (np.logaddexp(0, z) - bit * z)).sum() + 0.5 * ((w - start) ** 2).sum())

    w, now = start, loss(start)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip((w[place] * x).sum(axis=0), -30, 30)))
        slope = sum(np.bincount(place[k], n * (p - bit) * x[k], size) for k in range(CONTEXTS + 1)) + w - start
        bend = np.eye(size).ravel()
        for j in range(CONTEXTS + 1):
            for k in range(CONTEXTS + 1):
                bend = bend + np.bincount(place[j] * size + place[k], n * p * (1 - p) * x[j] * x[k], size * size)
        move = np.linalg.solve(bend.reshape(size, size), slope)
        while (then := loss(w - move)) > now and np.abs(move).max() > 1e-6:
            move /= 2
        if then > now:
            break
        w, now = w - move, then
        if np.abs(move).max() < 1e-6:
            break
    return w.reshape(CONTEXTS + 1, width).astype(np.float32)


def fit_mixer(tree: Tree, counts: np.ndarray, texts: list[bytes]) -> Mixer:
    """The mixer of few texts."""
    cells = np.zeros(_whole_segments(CELLS), np.int64)
    _add_cells(cells, tree, _packed_cells(tree), _left_out(counts), texts)
    return make_mixer(tree, counts, fit_weights(cells[:CELLS]))


def make_mixer(tree: Tree, counts: np.ndarray, weights: np.ndarray) -> Mixer:
    table = np.stack([weights[k + 1][_gate(c[:, 0], c[:, 1])] * _stretch(c[:, 0], c[:, 1]) for k, c in enumerate(counts)])
    table = np.clip(np.rint(table * STEPS), -127, 127).astype(np.int8)
    sign = ((1 - 2 * tree.bits) * (tree.nodes > 0)).astype(np.float32)
    return Mixer(tree, (tree.odds[tree.nodes] * weights[0, :LEVELS]).astype(np.float32), sign, table)


def foretelling(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, doc: np.ndarray, at: np.ndarray, told: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hit, log probability) of every token, zero where nothing is foretold.

    ``told`` holds all foretold words in a row, ``n`` of them from token ``at`` of
    document ``doc`` on, by rising documents and tokens. After r hits in a row and
    m failures in this chunk the next hit has probability (r + 0.7) / (r + 1 + 2 m).
    """
    hit, gain = np.zeros(len(words), bool), np.zeros(len(words))
    if not len(n):
        return hit, gain
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = at[of] + step
    inside = place < sizes[doc[of]]
    of, place, told = of[inside], place[inside] + starts[doc[of[inside]]], told[inside]
    fits = words[place] == told
    index = np.arange(len(place))
    chunk = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    whole = np.flatnonzero(np.concatenate([[True], doc[of[1:]] != doc[of[:-1]]]))
    failed = np.concatenate([[-1], np.maximum.accumulate(np.where(fits, -1, index))[:-1]])
    since = np.repeat(whole, np.diff(np.append(whole, len(index))))
    run = index - np.maximum(failed + 1, since)
    misses = np.concatenate([[0], np.cumsum(~fits)[:-1]])
    misses -= np.repeat(misses[chunk], np.diff(np.append(chunk, len(index))))
    p = (run + 0.7) / (run + 1 + 2 * misses)
    hit[place] = fits
    gain[place] = np.log(np.where(fits, p, 1 - p))
    return hit, gain


def _commonest(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All tokens from some count on: at most ``HEAD``, and as many as classes of about 1 % in count allow.

    A sort with a limit would send ``HEAD`` rows of every task to the driver.
    """
    classes = counts.groupBy(F.floor(F.log2("c") * 64).alias("class")).agg(F.min("c").alias("least"), F.count("*").alias("n"))
    least, held = None, 0
    for r in classes.orderBy(F.desc("class")).collect():  # at most 64 classes for each bit of a count
        held += r["n"]
        if held > HEAD:
            break
        least = r["least"]
    rows = [] if least is None else counts.where(F.col("c") >= least).collect()
    return np.array([r["token"] for r in rows], np.int64).view(np.uint64), np.array([r["c"] for r in rows], np.int64)


def _predictions(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(document, at, told words, how many) of a column of lists of (at, told), by document and then at."""
    lists = column.fill_null([]) if column.null_count else column
    doc = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    flat = lists.flatten()
    at, told = np.asarray(flat.field("at")), flat.field("told").to_pylist()
    order = np.lexsort((at, doc))
    told = [told[i] for i in order.tolist()]
    return doc[order], at[order], np.frombuffer(b"".join(told), "<u4"), np.array([len(t) // 4 for t in told], np.int64)


def score(docs: DataFrame, learn: str = "learn") -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte); ``learn``: a boolean column."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col(learn), F.lit(False)).alias("learn"), utf8("text").alias("text")).withColumn("doc", F.xxhash64("doc_id", "text", "learn"))
    training = docs.where("learn")
    gathered = stage(_gathered(docs), "gathered")
    counts = stage(gathered.where("token IS NOT NULL").groupBy("token").agg(F.sum("c").alias("c")), "counts")
    told = stage(_foretold(gathered.where("key IS NOT NULL").select("key", "next", "words", "doc", "at", "learn")), "told")
    release(gathered)
    all_ = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head, often = _commonest(counts)
    rare_n, rare_v = int(all_["n"] - often.sum()), all_["v"] - len(head)
    tree = build_tree(head, often, rare_n)
    contexts = _count_contexts(training, tree)
    weights = fit_weights(_count_cells(training, tree, contexts)[:CELLS])
    shared = spark.sparkContext.broadcast(make_mixer(tree, contexts, weights))
    log_head = np.append(np.log10(tree.counts + SMOOTH), 0.0)
    schema = "row long, doc_id long, learn boolean, bytes long, tokens long, head_tokens long, head_sum double, model double, tails array<struct<token:long,times:int,open:int>>"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = shared.value
        tree = mixer.tree
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            texts = whole.column(2).to_pylist()
            for a, z in parts([len(t) for t in texts], BYTES_AT_ONCE):
                b = whole.slice(a, z - a)
                found, sizes = tokens(texts[a:z])
                starts = np.cumsum(sizes) - sizes
                ids = tree.index(found)
                hit, gain = foretelling((found >> np.uint64(32)).astype(np.uint32), starts, sizes, *_predictions(b.column(3)))
                model = mixer.score(ids, sizes, ~hit) + np.add.reduceat(gain, starts)
                of = np.repeat(np.arange(len(sizes)), sizes)
                rare = np.flatnonzero(ids == len(tree.head))
                order = rare[np.lexsort((found[rare], of[rare]))]
                first = np.flatnonzero(np.concatenate([[True], (found[order][1:] != found[order][:-1]) | (of[order][1:] != of[order][:-1])])) if len(order) else order
                times = np.diff(np.append(first, len(order)))
                open_ = np.add.reduceat((~hit[order]).astype(np.int32), first) if len(order) else times
                upto = np.concatenate([[0], np.cumsum(np.bincount(of[order[first]], minlength=len(sizes)))]).astype(np.int32)
                columns = [pa.array(found[order[first]].view(np.int64)), pa.array(times.astype(np.int32)), pa.array(open_.astype(np.int32))]
                tails = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays(columns, ["token", "times", "open"]))
                n_rare = np.bincount(of[rare], minlength=len(sizes))
                sums = np.bincount(of, log_head[ids], len(sizes))
                out = [np.arange(row, row + len(sizes)), b.column(0), b.column(1), np.array([len(t) for t in texts[a:z]]), sizes, sizes - n_rare, sums, model]
                yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c) for c in out), tails], names)
                row += len(sizes)

    joined = docs.join(told, "doc", "left").select("doc_id", "learn", "text", "told")
    scored = stage(joined.mapInArrow(run, schema), "scored")
    tail = (
        scored.select("row", F.explode("tails").alias("t"))
        .select("row", "t.*")
        .join(counts, "token", "left")
        .select("row", "times", "open", F.coalesce("c", F.lit(0)).alias("c"))
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
            F.sum(F.col("times") * F.log10(F.col("c") + SMOOTH)).alias("tail_sum"),
            F.sum("open").alias("open"),
            F.sum(F.col("open") * F.log10(F.col("c") + SMOOTH)).alias("open_sum"),
        )
    )
    heads = scored.drop("tails").join(tail, "row", "left")
    known, tail_sum, open_, open_sum = (F.coalesce(c, F.lit(0)) for c in ("known", "tail_sum", "open", "open_sum"))
    all_log, rare_log = (float(np.log10(n + SMOOTH * (v + 1))) for n, v in ((all_["n"], all_["v"]), (rare_n, rare_v)))
    value = F.col("model") / float(np.log(10)) + open_sum - open_ * rare_log
    return heads.select(
        "doc_id",
        "learn",
        F.col("tokens").alias("n_tokens"),
        (F.col("head_tokens") + known).alias("n_known"),
        F.lit(all_["n"]).cast("long").alias("train_tokens"),
        (F.col("head_sum") + tail_sum - F.col("tokens") * all_log).alias("base_score"),
        value.alias("score"),
        (-value * float(np.log2(10)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("learn", id_remainder("doc_id", 10) != 0)
    found = score(docs.select("doc_id", "text", "learn"))
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
