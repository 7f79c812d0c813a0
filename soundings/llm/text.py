"""Words, hashes and batches shared by the text operators.

Everything here works on one Arrow batch inside a task.  A batch is walked in runs of
documents of bounded size, so that one task never holds more than a few megabytes of
derived arrays, whatever the number of documents; a single long document is one run.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

RUN_BYTES = 4 << 20
#: Words whose hash a worker remembers; the table is emptied when full.
REMEMBERED = 150_000
MULTIPLIER = 0x9E3779B97F4A7C15  # fixed value: odd, bits well spread


class WordHashes(dict):
    """64-bit hashes of words, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; NULL is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def runs(sizes: list[int], limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of at most ``limit`` bytes together, or of one longer text."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if sizes:
        yield start, len(sizes)


def text_runs(batches: Iterator[pa.RecordBatch], limit: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts (column ``text``), each of bounded size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for a, b in runs(sizes, limit):
            part = batch.slice(a, b - a)
            yield part, as_bytes(part.column("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^(n-1) and their inverses, modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                         for b in (base, inverse))
        _POWERS[base] = have
    return have[0][:n], have[1][:n]


def window_hashes(values: np.ndarray, width: int, base: int = MULTIPLIER) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive values; none if there are fewer values.

    A polynomial modulo 2^64 over values that are hashes themselves, taken from one running
    sum: window i is (S[i + width] - S[i]) / base^i.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(values), base)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up, out=total[1:])
        return mix((total[width:] - total[:n]) * down[:n])


def stretch_hashes(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """Hashes of stretches of values, each of its own size, as ``window_hashes``."""
    up, down = _powers(len(values), base)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up, out=total[1:])
        return mix((total[starts + sizes] - total[starts]) * down[starts] + sizes.astype(np.uint64) * np.uint64(MULTIPLIER))


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of any width by byte, first bytes first, so that small ones leave runs of zeros."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def steps(numbers: np.ndarray) -> np.ndarray:
    """Differences that ``np.cumsum`` undoes; small where the numbers ascend slowly."""
    return np.diff(numbers, prepend=numbers.dtype.type(0))


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``width`` that begins at one of ``starts``."""
    edge = np.bincount(starts, minlength=n + 1)[:n + 1] - np.bincount(starts + width, minlength=n + 1)[:n + 1]
    return np.cumsum(edge[:n]) > 0
