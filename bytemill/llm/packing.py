"""Order-preserving packing of token streams into fixed-length sequences by dynamic programming.

Each task packs the documents of its own partition in their order, so nothing
is shuffled. Words are separated at ASCII white space, which the tokenizer drops
anyway, and before the marks that close them; words met before are not encoded
again while they are remembered. The stream of a task is
cut in blocks. In a block the candidate cuts are document ends (free), sentence
ends (``SENTENCE_CUT``) and, where sentences run long, every ``STEP``-th token
(``WORD_CUT``); the cost of a sequence is its padding plus the penalty of its
cut plus ``PER_SEQUENCE``. A monotone queue gives the best start within the
window for each cut; starts a power of two away, which need no padding, are
looked up besides. The last sequences of a block are planned anew with the next
block, so the memory of a task is one block and one document.

Null text counts as empty: such a document is its end id alone. A null
``doc_id`` stays null. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from bytemill.llm.common import read, utf8
from bytemill.llm.hashing import parts

SEQUENCE = 4096
END_ID = 2
SENTENCE_CUT = 8
WORD_CUT = 64
STEP = 64
PER_SEQUENCE = 16
BLOCK = 64 * SEQUENCE
BYTES_AT_ONCE = 1 << 19
#: What a Python worker remembers of words, with about what an entry takes besides, in two generations: it keeps them between tasks. Longer words are not kept.
REMEMBERED_BYTES, ENTRY_BYTES, LONGEST_WORD = 24 << 20, 200, 64
#: Kinds of bytes: of ASCII marks, white space, ASCII letters and digits, and both bytes of Latin letters from U+00C0 to U+00FF.
_MARK, _SPACE, _LETTER, _LEAD, _SECOND = range(1, 6)
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127], _KINDS[[9, 10, 11, 12, 13, 32]] = _MARK, _SPACE
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[0xC3], _KINDS[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = _LEAD, _SECOND

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The printable stand-ins that byte-level tokenizers use for the 256 bytes, as a translation of Latin-1 text."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


def spelt(texts: list[bytes]) -> list[list[bytes]]:
    """The words of texts as the tokenizer tells them apart: A-Z in lower case, closing marks as words of their own.

    Case stays in texts where it may matter: beside combining marks, which are
    composed before it goes, and in the names of special tokens.
    """
    plain = [not (b"<|" in t or b"\xcc" in t or b"\xcd" in t) for t in texts]
    sizes = [len(t) + 1 for t in compress(texts, plain)]
    joined = b"\n".join(compress(texts, plain)).lower()
    kind = np.frombuffer(b"\n\n%b\n" % joined, np.uint8)
    kind = _KINDS[kind]
    mark = kind == _MARK
    edges = np.flatnonzero(mark[1:] != mark[:-1]) + 1
    first, after = edges[::2], edges[1::2]
    closes = (kind[first - 1] == _LETTER) | ((kind[first - 1] == _SECOND) & (kind[first - 2] == _LEAD))
    at = first[closes & (kind[after] == _SPACE)] - 2
    spaced = np.insert(np.frombuffer(joined, np.uint8), at, 32).tobytes()
    ends = np.cumsum([0, *sizes])
    ends = (ends + np.searchsorted(at, ends)).tolist()
    own = iter([spaced[a:b].split() for a, b in zip(ends, ends[1:])])
    return [next(own) if p else t.split() for p, t in zip(plain, texts, strict=True)]


class Encoder:
    """Token ids of whole texts; words met before are not encoded again.

    When the young generation is full it becomes the old one, and what the old
    one held is forgotten; a word of it that is met again goes over to the young one.

    A word of Latin letters is what the tokenizer's own splitter makes of it, so
    its model is asked directly; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held, self.once = 0, []
        vocabulary = self.tokenizer.get_vocab()
        self.sentence_ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.sentence_ends[[i for t, i in vocabulary.items() if t.removesuffix("</w>")[-1:] in tuple(".!?")]] = True

    def _whole(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, words: list[bytes]) -> None:
        others = []
        known, old, split = self.known, self.old, self.split
        size = len(known)
        texts = b" ".join(words).decode().split(" ")
        for raw, word in zip(words, texts, strict=True):
            ids = old.get(raw)
            if ids is None:
                stem = word.lower()
                if not (stem.isalpha() and ((plain := stem.isascii()) or max(stem) < "\u0250")):
                    others.append(raw)
                    continue
                text = stem if plain else stem.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in split(text)]).tobytes()
            known[raw] = ids
        known.update(zip(others, self._whole([w.decode() for w in others]), strict=True))
        self.once += [w for w in words if len(w) > LONGEST_WORD]
        self.held += sum(map(len, words)) + (len(known) - size) * ENTRY_BYTES

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        for word in self.once:
            self.known.pop(word, None)
        self.once = []
        if self.held > REMEMBERED_BYTES // 2:
            self.old, self.known, self.held = self.known, {}, 0
        words = spelt(texts)
        if new := set().union(*words).difference(self.known):
            self._learn(list(new))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, w)), "<u4") for w in words]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One a Python worker: what it has learnt serves the next task, too."""
    return Encoder(path)


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions after which a cut may fall, from 0 on, and their penalties."""
    penalty = np.full(len(ids) + 1, -1, np.int64)
    penalty[1:][sentence_ends[ids]] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[0] = penalty[-1] = 0
    at = np.flatnonzero(penalty >= 0)
    for i in np.flatnonzero(np.diff(at) > STEP):
        penalty[at[i] + STEP : at[i + 1] : STEP] = WORD_CUT
    at = np.flatnonzero(penalty >= 0)
    return at.tolist(), penalty[at].tolist()


def best_cuts(at: list[int], penalty: list[int], size: int = SEQUENCE) -> list[int]:
    """The cheapest cuts from ``at[0]`` to ``at[-1]`` in sequences of at most ``size``."""
    half, quarter = size // 2, size // 4  # exact lengths that are not padded
    index = {p: i for i, p in enumerate(at)}
    find = index.get
    cost, back = [0] * len(at), [0] * len(at)
    queue, queued, head = [at[0]], [0], 0  # cost + position, rising, and the candidate it belongs to
    for j in range(1, len(at)):
        p = at[j]
        while at[queued[head]] < p - size:
            head += 1
        best, start = queue[head] + size - p, queued[head]
        i = find(p - half)
        if i is not None and cost[i] < best:
            best, start = cost[i], i
        i = find(p - quarter)
        if i is not None and cost[i] < best:
            best, start = cost[i], i
        best += penalty[j] + PER_SEQUENCE
        cost[j], back[j] = best, start
        best += p
        while len(queue) > head and queue[-1] >= best:
            queue.pop()
            queued.pop()
        queue.append(best)
        queued.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def tail_cuts(begin: int, end: int, size: int = SEQUENCE) -> list[int]:
    """The last sequence of a stream: cut in powers of two where that costs less than its padding."""
    length = end - begin
    if length == size or size - length <= length.bit_count() * (WORD_CUT + PER_SEQUENCE):
        return [end]
    cuts = []
    for k in reversed(range(length.bit_length())):
        if length >> k & 1:
            begin += 1 << k
            cuts.append(begin)
    return cuts


class Packer:
    """The stream of one task: documents in, finished pieces out."""

    def __init__(self, sentence_ends: np.ndarray, first_sequence: int):
        self.sentence_ends, self.sequence = sentence_ends, first_sequence
        self.parts: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        total, start = len(ids), 0
        while start < total:
            part = ids[start : start + BLOCK - self.held]
            self.parts.append((doc_id, start, total, part))
            self.held += len(part)
            start += len(part)
            if self.held >= BLOCK:
                yield self.flush(keep=3)

    def flush(self, keep: int = 0) -> list[tuple]:
        """Pack what is held; the last ``keep`` sequences stay for the next block."""
        if not self.parts:
            return []
        ids = np.concatenate([p[3] for p in self.parts])
        ends = np.cumsum([len(p[3]) for p in self.parts])
        closed = [e for e, p in zip(ends.tolist(), self.parts, strict=True) if p[1] + len(p[3]) == p[2]]
        cuts = best_cuts(*candidate_cuts(ids, np.array(closed, np.int64), self.sentence_ends))
        cuts = cuts[: len(cuts) - keep] if keep else cuts[:-1] + tail_cuts(cuts[-2] if cuts[1:] else 0, cuts[-1])
        rows, kept, k, begin = [], [], 0, 0
        for (doc_id, start, total, part), end in zip(self.parts, ends.tolist(), strict=True):
            at = end - len(part)
            while at < end and k < len(cuts):
                to = min(end, cuts[k])
                piece = ids[at:to]
                rows.append((doc_id, start + at - (end - len(part)), to - at, zlib.crc32(piece.tobytes()), total, self.sequence, at - begin))
                at = to
                if to == cuts[k]:
                    k, begin, self.sequence = k + 1, to, self.sequence + 1
            if at < end:
                gone = at - (end - len(part))
                kept.append((doc_id, start + gone, total, part[gone:]))
        self.parts, self.held = kept, sum(len(p[3]) for p in kept)
        return rows


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: where it comes from, and its place in a sequence."""
    path = path or tokenizer_path()
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        packer = Packer(encode.sentence_ends, TaskContext.get().partitionId() << 33)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        end = np.array([END_ID], "<u4")
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for at, to in parts(sizes, BYTES_AT_ONCE):
                part = b.slice(at, to - at)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    for rows in packer.add(doc_id, np.concatenate([ids, end])):
                        if rows:
                            yield out(rows)
        if rows := packer.flush():
            yield out(rows)

    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(run, SCHEMA)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
