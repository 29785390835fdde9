"""Words of texts as arrays: positions and 64-bit hashes for whole Arrow columns.

A word is a longest run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return.  Texts are handled in pieces of about a megabyte,
so a task's memory follows its longest text, not its share of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
SMALL_PIECE = 1 << 18  # where arrays of many times a piece's size are made of it
SPACES = b" \t\n\x0b\x0c\r"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20_011).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits; a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as many as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (_powers(b, n) for b in (_BASE, _INVERSE))
        return self.up, self.down


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWERS = _Powers()


@dataclass
class Words:
    """The words of several texts: word ``w`` of text ``t`` has an index in ``first[t]:first[t + 1]``."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray  # one unsigned 64-bit hash per word

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of every run of ``n`` words inside one text, and the runs' hashes."""
        total = len(self.hashes) - n + 1
        if total <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        value = np.zeros(total, dtype=np.uint64)
        for i in range(n):
            value = mix(value + self.hashes[i : i + total])
        inside = np.ones(len(self.hashes), dtype=bool)
        for back in range(1, n):
            at = self.first[1:] - back
            inside[at[at >= self.first[:-1]]] = False
        at = np.flatnonzero(inside[:total])
        return at, value[at]

    def grams(self, n: int) -> np.ndarray:
        """The hash of ``n`` words from each word on, across texts, too: differences of sums, so a long run costs what a short one does."""
        total = len(self.hashes) - n + 1
        if total <= 0:
            return np.empty(0, dtype=np.uint64)
        up, down = _POWERS.upto(len(self.hashes) + 1)
        sums = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
        np.cumsum(self.hashes * up[: len(self.hashes)], out=sums[1:])
        return mix((sums[n:] - sums[:total]) * down[:total])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``runs``, for long runs: their first words, their texts and their hashes."""
        count = np.maximum(self.counts() - n + 1, 0)
        text = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(text)) + (self.first[:-1] - np.cumsum(count) + count)[text]
        return at, text, self.grams(n)[at]


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """All words of a string array; a null counts as an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return split_bytes(_LOWER[data] if lower else data, offsets - offsets[0])


def split_bytes(data: np.ndarray, offsets: np.ndarray) -> Words:
    """All words of texts in UTF-8 that lie behind each other; text ``t`` is ``data[offsets[t]:offsets[t + 1]]``."""
    n = len(data)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _POWERS.upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, np.searchsorted(start, offsets), hashes)


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows so that a piece holds about ``size`` bytes, a megabyte, of the text column."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at, done = 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])
