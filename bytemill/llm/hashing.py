"""64-bit hashes of words and of runs of words, in numpy over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once, which bounds a task's memory.
BYTES_AT_ONCE = 1 << 16

_SPACES = (9, 10, 11, 12, 13, 32)
_IS_SPACE = bytes(b in _SPACES for b in range(256))
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers_to(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base modulo 2 ** 64, and of its inverse."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        pair = []
        for base in (_BASE[kind], pow(_BASE[kind], -1, 1 << 64)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps))
        _powers[kind] = tuple(pair)
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) ^ (h >> np.uint64(32))


def run_sums(values: np.ndarray, kind: str = "word") -> np.ndarray:
    """Prefix sums from which the hash of any run of ``values`` follows."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers_to(kind, len(values) + 1)[0][: len(values)], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, kind: str = "word") -> np.ndarray:
    return mix((sums[end] - sums[start]) * _powers_to(kind, len(sums))[1][start])


def _placed(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, first byte) of each word, part by part; parts end between words."""
    at = 0
    while at < len(text):
        end = at + BYTES_AT_ONCE
        while end < len(text) and not _IS_SPACE[text[end]]:
            end += 1
        part = text[at:end]
        edges = np.diff(np.frombuffer(b"\1" + part.translate(_IS_SPACE) + b"\1", np.int8))
        sums = run_sums(np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1), "byte")
        starts = np.flatnonzero(edges == -1)
        yield run_hash(sums, starts, np.flatnonzero(edges == 1), "byte"), starts + at
        at = end


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in _placed(text))])


def texts_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of several texts in a row, and how many each text has."""
    hashes, starts = zip(*_placed(b"\n".join(texts)), strict=True) if any(texts) else ((), ())
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(np.concatenate([np.zeros(0, np.int64), *starts]), ends)
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.diff(np.concatenate([[0], upto]))


def parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices (from, to) of rows that together hold at most ``most``, or one row."""
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)
