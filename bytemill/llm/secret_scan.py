"""Secret scan: fixed patterns, and a character convolutional network over all other candidates.

A candidate is a run of 12 token characters or more that no pattern covers whole.
The network reads it with the ``AROUND`` characters on either side, in windows of
``WIDTH`` characters if it is long (the highest score counts).

It has to know a secret by its value, not by the patterns' keywords. So what it
learns from are, as secrets: the patterns' findings, in their own context and in
those of other candidates, and random strings of several alphabets
(``planted``), in such contexts, too; as others: the other candidates, and words
and numbers joined as in names, paths and dates (``harmless``). All distinct windows
are learnt from, of every row: they are dealt by hash into blocks of about ``BLOCK``,
each block makes strings of its own (``MADE`` in all, ``LEAST_MADE`` at least), and a
round teaches every block all its windows from the same network on; the next
network is the mean of theirs. The very first is taught made strings alone, so there
is a network for tables without findings as well. A quarter of the values of all
blocks is kept apart to calibrate the scores and to set the threshold: the highest
one, in steps of a ``FINE``-th of a log odd, that still recalls ``RECALL`` of the
secrets. Candidates at or above it are added as kind ``model``, without the parts
that patterns cover; the patterns' spans always stay.

Texts are scanned once and whole. Null text counts as empty. Rows with null or
repeated ids are scanned like any other. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.llm.common import read, release, stage, unused

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE_SIZE = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_SIZE)

AROUND, WIDTH = 16, 48
MADE, LEAST_MADE = 1500, 64
RECALL = 0.98
FILTERS, TAPS, EMBED = 16, 5, 8
STEPS, BATCH = 700, 64
#: Windows of a block, about; rounds over findings and made strings, and then over all windows.
BLOCK, FIRST_ROUNDS, ROUNDS = 4096, 2, 2
BLOCK_STEPS, BLOCK_BATCH, BLOCK_RATE = 16, 256, 0.01
#: Steps of a log odd that are told apart in calibration, and up to which it is counted.
FINE, FAR = 64, 64
#: Parts of one in which sums over blocks are kept: integers, so that their order is free.
UNIT = 1 << 30

_HEX_ONLY = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_LENGTH = 2 * AROUND + WIDTH
#: Characters as the network sees them: printable ASCII, then any other, then none.
_OTHER, _NONE = 95, 96


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' findings in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if b"h" * LEAST["hex"] in text.encode().translate(_HEX_ONLY):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(start, end, label, open): runs of token characters; label 1 if a pattern covers part of it, and the parts that none covers."""
    found, k = [], 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][2] <= m.start():
            k += 1
        at, open_, inside = m.start(), [], 0
        for _, a, b in itertools.takewhile(lambda s, end=m.end(): s[1] < end, itertools.islice(base, k, None)):
            if b > m.start():
                inside = 1
                if a > at:
                    open_.append((at, a))
                at = max(at, b)
        if at < m.end():
            open_.append((at, m.end()))
        found.append((m.start(), m.end(), inside, open_))
    return found


def windows(text: str, start: int, end: int) -> list[str]:
    """Windows of AROUND + WIDTH + AROUND characters over a candidate; NUL marks where the text has none."""
    out = []
    for at in range(start, end, WIDTH):
        to = min(end, at + WIDTH)
        left, right = text[max(0, at - AROUND) : at], text[to : to + AROUND]
        out.append(left.rjust(AROUND, "\0") + text[at:to].ljust(WIDTH, "\0") + right.ljust(AROUND, "\0"))
    return out


def _codes(texts: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(-1, _LENGTH).astype(np.int64)
    return np.where(points == 0, _NONE, np.where((points >= 32) & (points < 127), points - 32, _OTHER))


@dataclass
class Network:
    """Embedding, one convolution, the maximum over each region (before, candidate, after), and a logistic output."""

    embed: np.ndarray
    filters: np.ndarray  # (TAPS * EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (3 * FILTERS + 1,)
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    #: Where the convolution's outputs of each region begin and end.
    REGIONS = ((0, AROUND - TAPS + 1), (AROUND - TAPS + 1, AROUND + WIDTH), (AROUND + WIDTH, _LENGTH - TAPS + 1))

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        x = self.embed[codes]
        n = _LENGTH - TAPS + 1
        columns = np.concatenate([x[:, t : t + n] for t in range(TAPS)], axis=2)
        hidden = np.maximum(columns @ self.filters + self.bias, 0)
        places = [hidden[:, a:b].argmax(axis=1) + a for a, b in self.REGIONS]
        rows = np.arange(len(codes))[:, None]
        pooled = np.concatenate([hidden[rows, p, np.arange(FILTERS)] for p in places] + [np.ones((len(codes), 1), hidden.dtype)], axis=1)
        return columns, places, pooled, pooled @ self.out

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[at : at + 1024])[3] for at in range(0, len(codes), 1024)]) if len(codes) else np.zeros(0)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.probability(self.logits(codes))

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * np.asarray(logits, float) + self.shift, -30, 30)))


def planted(rng: np.random.Generator, n: int) -> list[str]:
    """Random strings as keys and tokens look: of one alphabet, some with a short name before or cut by dashes."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_", lower + digits, upper + digits, digits + "abcdef", digits + "ABCDEF"]
    out = []
    for _ in range(n):
        alphabet = list(alphabets[rng.integers(len(alphabets))])
        size = int(rng.integers(16, WIDTH + 1))
        value = "".join(rng.choice(alphabet, size))
        kind = rng.integers(6)
        if kind == 0:
            value = "".join(rng.choice(list(lower), int(rng.integers(2, 5)))) + "_" + value
        elif kind == 1:
            value = "-".join(value[i : i + 8] for i in range(0, size, 8))
        elif kind == 2:
            value += "=" * int(rng.integers(1, 3))
        out.append(value[:WIDTH])
    return out


def harmless(rng: np.random.Generator, n: int, words: list[str]) -> list[str]:
    """Long words, joined words and numbers: what names, paths, card numbers and dates look like."""
    out = []
    for _ in range(n):
        some = [words[i] for i in rng.integers(0, len(words), 4)]
        numbers = ["".join(rng.choice(list("0123456789"), int(rng.integers(2, 9)))) for _ in range(3)]
        kind = rng.integers(8)
        if kind == 0:
            value = "".join(rng.choice(list("0123456789"), int(rng.integers(12, 21))))
        elif kind == 1:
            value = "-".join([*numbers, "".join(rng.choice(list("0123456789"), 4))])
        elif kind == 2:
            value = some[0] + some[1] + some[2]
        elif kind == 3:
            value = (some[0] + some[1] + some[2]).upper()
        elif kind == 4:
            value = "".join(w.capitalize() for w in some)
        else:
            value = "/-_="[rng.integers(4)].join(some[: rng.integers(2, 5)] + numbers[: rng.integers(0, 2)])
        out.append(value[:WIDTH].ljust(CANDIDATE_SIZE, value[-1]))
    return out


def lessons(found: list[str], others: list[str], made: int = MADE, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """The windows to learn from and their labels, given those of the patterns' findings and of other candidates."""
    rng = np.random.default_rng(seed)
    contexts = [(w[:AROUND], w[-AROUND:]) for w in others] or [("\0" * AROUND, "\0" * AROUND), (" " * AROUND, " " * AROUND)]
    letters = {w[AROUND:-AROUND].rstrip("\0").lower() for w in others}
    words = sorted(w[i : i + 6] for w in letters if w.isalpha() for i in range(0, len(w) - 5, 6))
    before, vowels, after = "b c d f g h k l m n p r s t v w st tr sch th bl pr qu".split(), "a e i o u ei ou ea io".split(), ["", "", "n", "r", "s", "l", "t", "ng", "nd", "th", "ch"]
    words += ["".join(rng.choice(x) for _ in range(2) for x in (before, vowels, after)) for _ in range(500)]

    def placed(value: str) -> str:
        left, right = contexts[rng.integers(len(contexts))]
        return left + value.ljust(WIDTH, "\0") + right

    good = [*found, *(placed(w[AROUND:-AROUND]) for w in found), *map(placed, planted(rng, made))]
    bad = [*others, *map(placed, harmless(rng, made, words))]
    return good + bad, np.array([1.0] * len(good) + [0.0] * len(bad))


PARAMETERS = ("embed", "filters", "bias", "out")


def _descend(net: Network, codes: np.ndarray, labels: np.ndarray, batches: Iterator[np.ndarray], rate: float) -> None:
    """Adam on the logistic loss, in place; both labels weigh the same in a batch."""
    mean, square = ({k: np.zeros_like(getattr(net, k)) for k in PARAMETERS} for _ in range(2))
    for step, batch in enumerate(batches, 1):
        columns, places, pooled, logit = net.forward(codes[batch])
        label = labels[batch]
        weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) * weight).astype(net.out.dtype)
        grad = {"out": pooled.T @ error, "filters": np.zeros_like(net.filters), "bias": np.zeros_like(net.bias), "embed": np.zeros_like(net.embed)}
        rows = np.arange(len(batch))[:, None]
        for r, place in enumerate(places):
            own = slice(r * FILTERS, (r + 1) * FILTERS)
            back = error[:, None] * net.out[own] * (pooled[:, own] > 0)  # (batch, filters)
            seen = columns[rows, place]  # (batch, filters, taps * embed)
            grad["filters"] += np.einsum("bf,bfc->cf", back, seen)
            grad["bias"] += back.sum(axis=0)
            into = np.einsum("bf,cf->bfc", back, net.filters).reshape(len(batch), FILTERS, TAPS, EMBED)
            for t in range(TAPS):
                at = codes[batch][rows, place + t].ravel()
                for e in range(EMBED):
                    grad["embed"][:, e] += np.bincount(at, into[:, :, t, e].ravel(), len(net.embed))
        for k in PARAMETERS:
            mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
            square[k] = 0.999 * square[k] + 0.001 * grad[k] ** 2
            getattr(net, k)[...] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)


def _kept_apart(texts: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(t[AROUND:-AROUND].encode()) % 4 == 0 for t in texts])


def train(texts: list[str], labels: np.ndarray, recall: float = RECALL) -> Network:
    """A network from few windows; a quarter of the values is kept apart for calibration and the threshold."""
    rng = np.random.default_rng(7)
    codes = _codes(texts)
    apart = _kept_apart(texts)
    kept, used = np.flatnonzero(apart), np.flatnonzero(~apart)
    net = Network(rng.normal(0, 0.3, (97, EMBED)), rng.normal(0, 0.2, (TAPS * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS + 1))
    ones, zeros = used[labels[used] == 1], used[labels[used] == 0]
    _descend(net, codes, labels, (np.concatenate([rng.choice(ones, BATCH // 2), rng.choice(zeros, BATCH // 2)]) for _ in range(STEPS)), 0.01)
    logit, label = net.logits(codes[kept]), labels[kept]
    for _ in range(200):  # Platt scaling
        p = 1 / (1 + np.exp(-np.clip(net.scale * logit + net.shift, -30, 30)))
        net.scale -= 0.1 * float(((p - label) * logit).mean())
        net.shift -= 0.1 * float((p - label).mean())
    good = np.sort(net.scores(codes[kept])[label == 1])
    net.threshold = float(good[int((1 - recall) * len(good))]) if len(good) else 1.0
    return net


def calibrated(net: Network, bins: np.ndarray, goods: np.ndarray, bads: np.ndarray, recall: float = RECALL) -> Network:
    """``net`` with its scale, shift and threshold, from how many windows of each label have log odds from ``bins / FINE`` on."""
    order = np.argsort(bins)
    edge, goods, bads = bins[order] / FINE, goods[order].astype(float), bads[order].astype(float)
    x, n = edge + 0.5 / FINE, goods + bads
    hits = goods * ((goods.sum() + 1) / (goods.sum() + 2)) + bads / (bads.sum() + 2)
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)])

    def loss(w: np.ndarray) -> float:
        z = w @ design
        return float((n * np.logaddexp(0, z) - hits * z).sum() + 0.5e-3 * ((w - [1, 0]) ** 2).sum())

    for _ in range(100):  # Platt scaling by damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(w @ design, -30, 30)))
        slope = design @ (n * p - hits) + 1e-3 * (w - [1, 0])
        move = np.linalg.solve((design * (n * p * (1 - p))) @ design.T + 1e-3 * np.eye(2), slope)
        while loss(w - move) > loss(w) and np.abs(move).max() > 1e-9:
            move /= 2
        w = w - move
        if np.abs(move).max() < 1e-9:
            break
    found = replace(net, scale=max(float(w[0]), 1e-3), shift=float(w[1]))
    if goods.sum():
        below = np.cumsum(goods) - goods
        found.threshold = float(found.probability(edge[np.flatnonzero(below <= (1 - recall) * goods.sum())[-1]]))
    return found


def _found(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, the patterns' spans and the candidates with their windows."""
    fields = [docs.schema[c] for c in keep]
    own = [unused(keep, "base"), unused(keep, "tried")]
    spans = f"`{own[0]}` array<struct<kind:string,start:long,end:long>>"
    tried = f"`{own[1]}` array<struct<start:long,end:long,label:int,open:array<struct<start:long,end:long>>,windows:array<string>>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), spans, tried])
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    tried_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("open", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("windows", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_base, all_tried = [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                base = base_spans(text or "")
                all_base.append([{"kind": k, "start": a, "end": e} for k, a, e in base])
                all_tried.append([{"start": a, "end": e, "label": y, "open": [{"start": i, "end": j} for i, j in o], "windows": windows(text, a, e)} for a, e, y, o in candidates(text or "", base)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(all_base, base_type), pa.array(all_tried, tried_type)], [*keep, *own])

    return docs.select(*keep, F.col("text").alias(unused(keep, "text"))).mapInArrow(run, schema)


def _blocks(found: DataFrame) -> DataFrame:
    """(codes, label, other, apart): the lessons of each block, from all distinct windows of ``found``; other: a candidate of the texts without a finding."""
    tried = found.select(F.explode(found.columns[-1]).alias("t")).select("t.label", F.explode("t.windows").alias("w"))
    n = max(1, round(tried.count() / BLOCK))
    made = max(LEAST_MADE, -(-MADE // n))
    tasks = min(n, max(2 * found.sparkSession.sparkContext.defaultParallelism, -(-n // 16)))  # the bytes are few, the work is not
    own = tried.distinct().withColumn("block", F.pmod(F.xxhash64("w"), F.lit(n))).repartition(tasks, "block")
    dealt = own.groupBy("block").agg(F.collect_list("label").alias("label"), F.collect_list("w").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, label, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                known = sorted(zip(label, w, strict=True))
                others = [x for y, x in known if not y]
                texts, labels = lessons([x for y, x in known if y], others, made, block)
                other = np.zeros(len(texts), np.uint8)
                other[len(texts) - len(others) - made : len(texts) - made] = 1
                parts = (_codes(texts), labels, other, _kept_apart(texts))
                yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x.astype(np.uint8).tobytes()], pa.binary()) for x in parts)], ["block", "codes", "label", "other", "apart"])

    return dealt.mapInArrow(run, "block long, codes binary, label binary, other binary, apart binary")


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for block, *blobs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            codes, label, other, apart = (np.frombuffer(x, np.uint8) for x in blobs)
            yield block, codes.reshape(-1, _LENGTH).astype(np.int64), label, other == 1, apart == 1


def _single(net: Network) -> Network:
    """``net`` in single precision, as a copy."""
    return replace(net, **{k: getattr(net, k).astype(np.float32) for k in PARAMETERS})


def _lesson_of(codes: np.ndarray, other: np.ndarray, first: Network | None) -> np.ndarray:
    """What a block may teach: without ``first`` no other candidates, with it those that it doesn't take for secrets."""
    use = ~other
    if first is not None:
        at = np.flatnonzero(other)
        use[at] = first.scores(codes[at]) < first.threshold
    return use


def _cycled(rng: np.random.Generator, items: np.ndarray, size: int) -> np.ndarray:
    """``items`` shuffled, over and over."""
    return rng.permutation(items)[np.arange(size) % len(items)]


def _round(blocks: DataFrame, net: Network, first: Network | None, rate: float, least: int = BLOCK_STEPS) -> Network:
    """The mean of the networks that the blocks make of ``net``, by what they learnt from; every window is seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = 0, 0
        for block, codes, label, other, apart in _each_block(batches):
            use = _lesson_of(codes, other, first) & ~apart
            ones, zeros = np.flatnonzero(use & (label == 1)), np.flatnonzero(use & (label == 0))
            if not len(ones) or not len(zeros):
                continue
            own, rng = _single(net), np.random.default_rng(block)
            good, bad = (BLOCK_BATCH // 4, 3 * BLOCK_BATCH // 4) if first else (BATCH // 2, BATCH // 2)
            steps = max(least, -(-len(zeros) // bad), -(-len(ones) // good))
            a, z = _cycled(rng, ones, steps * good).reshape(steps, good), _cycled(rng, zeros, steps * bad).reshape(steps, bad)
            _descend(own, codes, label, iter(np.concatenate([a, z], axis=1)), rate)
            n = len(ones) + len(zeros)
            moved = np.concatenate([(getattr(own, k).astype(float) - getattr(net, k)).ravel() for k in PARAMETERS])
            total, weight = total + np.rint(moved * n * UNIT).astype(np.int64), weight + n
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], ["weight", "total"])

    rows = blocks.mapInArrow(run, "weight long, total binary").collect()  # a network of a few thousand numbers from each task
    if not rows:
        return net
    mean = sum(np.frombuffer(r["total"], np.int64) for r in rows) / (UNIT * sum(r["weight"] for r in rows))
    ends = np.cumsum([getattr(net, k).size for k in PARAMETERS])
    return replace(net, **{k: getattr(net, k) + m.reshape(getattr(net, k).shape) for k, m in zip(PARAMETERS, np.split(mean, ends[:-1]), strict=True)})


def _calibrate(blocks: DataFrame, net: Network, first: Network | None) -> Network:
    """``net``, calibrated on all that is kept apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2 * FINE * FAR), np.int64)
        own = _single(net)
        for _, codes, label, other, apart in _each_block(batches):
            codes, label, other = codes[apart], label[apart], other[apart]
            use = _lesson_of(codes, other, first)
            place = np.clip(np.floor(own.logits(codes[use]) * FINE), -FINE * FAR, FINE * FAR - 1).astype(np.int64) + FINE * FAR
            np.add.at(counts, (label[use], place), 1)
        label, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.where(label, counts[label, place], 0)), pa.array(np.where(label, 0, counts[label, place]))], ["bin", "goods", "bads"])

    counts = blocks.mapInArrow(run, "bin long, goods long, bads long").groupBy("bin").agg(F.sum("goods").alias("goods"), F.sum("bads").alias("bads")).collect()
    if not counts:
        return net
    bins, goods, bads = (np.array([r[k] for r in counts], np.int64) for k in ("bin", "goods", "bads"))
    return calibrated(net, bins - FINE * FAR, goods, bads)


def _learn(found: DataFrame) -> Network:
    """The network of all windows.

    Some of the other candidates may be secrets themselves: what a first network,
    taught without them, takes for a secret is not a counterexample to the second.
    """
    blocks = stage(_blocks(found), "blocks")
    least = max(BLOCK_STEPS, STEPS // max(1, blocks.count()))  # few blocks take more steps
    first = train(*lessons([], []))
    for _ in range(FIRST_ROUNDS):
        first = _round(blocks, first, None, BLOCK_RATE, least)
    net = first = _single(_calibrate(blocks, first, None))
    for k in range(ROUNDS):
        net = _round(blocks, net, first, BLOCK_RATE / 2**k, least)
    net = _single(_calibrate(blocks, net, first))
    release(blocks)
    return net


def _judged(docs: DataFrame, keep: list[str], finish: Callable[[pa.RecordBatch, list[list[dict]]], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``finish`` makes of each batch (``keep`` first) and its rows' spans, by start and then kind."""
    found = stage(_found(docs, *keep), "findings")
    net = _learn(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, tried in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True):
                spans = [s | {"score": 1.0} for s in base]
                others = [t for t in tried if t["open"]]
                if others:
                    scores = net.scores(_codes([w for t in others for w in t["windows"]]))
                    ends = np.cumsum([len(t["windows"]) for t in others])
                    for t, best in zip(others, np.maximum.reduceat(scores, ends - [len(t["windows"]) for t in others]), strict=True):
                        if best >= net.threshold:
                            spans += [{"kind": "model", **o, "score": float(best)} for o in t["open"]]
                out.append(sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield finish(b, out)

    return found.mapInArrow(run, schema)


def find_secrets(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of every row and spans: array<struct<kind, start, end, score>>, by start and then kind."""
    span = "array<struct<kind:string,start:long,end:long,score:double>>"
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"spans {span}"])

    def finish(b: pa.RecordBatch, spans: list[list[dict]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(spans, span_type)], [*keep, "spans"])

    return _judged(docs, list(keep), finish, schema)


def _listed(spans) -> object:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"), "doc_id")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), count("model")
    )


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """The rows of ``docs`` with every secret in ``text`` replaced by ``mark`` (and n_chars counted anew where it is a column)."""
    columns = list(docs.columns)
    at = columns.index("text")

    def finish(b: pa.RecordBatch, all_spans: list[list[dict]]) -> pa.RecordBatch:
        texts = []
        for text, spans in zip(b.column(at).to_pylist(), all_spans, strict=True):
            for s in reversed(_merged(spans)):
                text = text[: s[0]] + mark + text[s[1] :]
            texts.append(text)
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[: len(columns)])], columns)

    clean = _judged(docs, columns, finish, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else clean


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out
