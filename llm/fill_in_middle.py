"""Fill-in-the-middle transformation with content-defined chunk memoization.

A text's units are words with the white space before them; white space at its end is one more
unit.  Two cuts drawn from the document's id part the text into prefix, middle and suffix.

A rolling hash over the last bytes decides where a text is cut into chunks, so texts that
share a passage share most chunks of it.  A chunk's boundary summary holds how many words end
inside it, its code points, and whether it begins and ends within a word.  Summaries are kept
by the chunk's bytes: a hash finds the entry and the bytes are compared, so a chunk that only
has the same hash is never taken for another.  Summaries of adjacent chunks combine to counts
for the whole text, running counts name the chunk that holds a cut, and only that
chunk is read word by word.

Each row is handled on its own, so the work is one pass over the documents without a
shuffle.  What a worker remembers is bounded and never changes a result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.words import mix, pieces

WINDOW, SHORTEST, LONGEST = 32, 256, 16_384  # bytes; a window never reaches back over the start of a chunk
MEAN_BITS = 10
REMEMBERED_BYTES = 64 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_VALUES = np.random.default_rng(1_301).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15
_SPACE = frozenset(b" \t\n\x0b\x0c\r")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_CONTINUATION = bytes(range(0x80, 0xC0))


class Summary(NamedTuple):
    ends: int  # words that end inside the chunk, before its last byte
    chars: int
    begins_in_word: bool
    ends_in_word: bool


def summarise(chunk: bytes) -> Summary:
    ends_in_word = chunk[-1] not in _SPACE
    return Summary(len(chunk.split()) - ends_in_word, code_points(chunk), chunk[0] not in _SPACE, ends_in_word)


def code_points(raw: bytes) -> int:
    return len(raw.translate(None, _CONTINUATION))


def cut_points(data: np.ndarray) -> np.ndarray:
    """Places (ascending) where the hash of the last ``WINDOW`` bytes asks for a cut."""
    if len(data) < WINDOW:
        return np.empty(0, dtype=np.int64)
    value, power, have = _VALUES[data], _BASE, 1
    while have < WINDOW:  # the hash of a run of 2n bytes from those of its halves
        value = value[:-have] * np.uint64(power) + value[have:]
        power, have = power * power % 2**64, 2 * have
    return np.flatnonzero(mix(value) >> np.uint64(64 - MEAN_BITS) == 0) + WINDOW


def chunk_ends(points: np.ndarray, start: int, end: int) -> list[int]:
    """Where the chunks of the text in ``start:end`` end: at the first point that leaves no chunk too short or too long."""
    found, at = [], start
    while end - at > SHORTEST:
        next_ = int(np.searchsorted(points, at + SHORTEST))
        at = min(int(points[next_]) if next_ < len(points) else end, at + LONGEST, end)
        found.append(at)
    if at < end:
        found.append(end)
    return found


class Memory:
    """Boundary summaries of the chunks seen, by content; forgets all when it is full."""

    def __init__(self, most_bytes: int = REMEMBERED_BYTES) -> None:
        self.known: dict[bytes, Summary] = {}
        self.held, self.most_bytes = 0, most_bytes

    def summary(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            found = summarise(chunk)
            if self.held > self.most_bytes:
                self.known, self.held = {}, 0
            self.known[chunk] = found
            self.held += len(chunk) + 200
        return found


class Chunked:
    """A text as chunks with their summaries."""

    def __init__(self, chunks: list[bytes], memory: Memory) -> None:
        self.chunks, self.parts = chunks, [memory.summary(c) for c in chunks]
        follows = [p.begins_in_word for p in self.parts[1:]] + [False]
        # A word that reaches a chunk's end ends there if the next chunk does not go on with it.
        self.ends = list(accumulate(p.ends + (p.ends_in_word and not f) for p, f in zip(self.parts, follows)))
        self.units = self.ends[-1] + (not self.parts[-1].ends_in_word) if chunks else 0

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if not units or not self.chunks:
            return 0, 0
        if units > self.ends[-1]:
            return sum(map(len, self.chunks)), sum(p.chars for p in self.parts)
        at = int(np.searchsorted(self.ends, units))
        left = units - (self.ends[at - 1] if at else 0)
        chunk = self.chunks[at]
        place = next(islice(_WORD.finditer(chunk), left - 1, None)).end()
        return sum(map(len, self.chunks[:at])) + place, sum(p.chars for p in self.parts[:at]) + code_points(chunk[:place])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 that only the seed and the id decide; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


_MEMORY = Memory()


def _transform(seed: int, percent: int, spm_percent: int):
    def rows(piece: pa.RecordBatch) -> Iterator[tuple]:
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in piece.column("text")]
        whole = b"".join(texts)
        points, start = cut_points(np.frombuffer(whole, dtype=np.uint8)), 0
        for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts):
            ends = chunk_ends(points, start, start + len(text))
            cut = Chunked([whole[a:b] for a, b in zip([start, *ends], ends)], _MEMORY)
            start += len(text)
            h1, h2, h3, h4 = draws(seed, doc_id)
            if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= percent:
                yield cut.units, "plain", None, None, text.decode()
                continue
            first, last = sorted((h1 % (cut.units + 1), h2 % (cut.units + 1)))
            (a, a_chars), (b, b_chars) = cut.cut(first), cut.cut(last)
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            if h4 % 100 < spm_percent:
                form, output = "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
            else:
                form, output = "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
            yield cut.units, form, a_chars, b_chars - a_chars, output.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                n, form, prefix, middle, output = zip(*rows(piece))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                     pa.array(output, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Per document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    ``percent`` of the documents are transformed, ``spm_percent`` of these with the suffix first.  A
    null or empty text has no unit and is plain, as is one that holds a marker; a null id draws as
    one without digits.  Every row gives one row, so repeated rows give repeated rows; other columns
    are not read.  A very long text is held whole by its own task, with one summary per chunk.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _transform(seed, percent, spm_percent), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from which an output was made; a text that holds markers is never parted, so the first ones decide."""
    whole, kind = F.col(output), F.col(form)
    first = F.when(kind == "spm", F.lit(PREFIX.decode())).otherwise(F.lit(SUFFIX.decode()))
    a = F.position(first, whole)
    b = F.position(F.lit(MIDDLE.decode()), whole, a + 3)
    head, tail = F.substr(whole, F.lit(4), a - 4), F.substr(whole, a + 3, b - a - 3)
    middle = F.substr(whole, b + 3, F.length(whole))
    return (
        F.when(kind == "plain", whole).when(kind == "spm", F.concat(tail, middle, head)).otherwise(F.concat(head, middle, tail))
    )
