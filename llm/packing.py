"""Packing documents into token sequences: first-fit decreasing over a tournament tree.

A document's ids are cut into pieces of a full sequence and one remainder.  The pieces go
to randomised groups of about ``group`` each, by a hash of their place in the table.  In
a group full pieces are sequences of their own; the remainders, longest first, each go to
the first sequence with room.  A tournament tree over the sequences' free space finds it in
logarithmic time.

Tokens are counted and summed where the documents lie; only a few numbers per piece are
written and shuffled.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut_lineage, quiet_shuffles, small_batches
from llm.words import pieces

CAPACITY = 2048
END = 1
# Parts of words whose ids a worker keeps, about 200 bytes each; the rest are tokenized anew.
_KNOWN = 1_000_000
_MARKS = ".,;:!?%$#&*"


class Tokens:
    """Ids of texts, word by word.

    The tokenizer ignores case, drops white space and never joins what it separates, so a
    text's ids are those of its words, one after another.  Nor does it join letters and the
    marks after them, so a word is a stem and its marks.  Arrow splits texts and words and numbers
    the distinct parts; each of these is looked up once.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}

    def _found(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts as bytes; those not yet known are tokenized in one go."""
        found = list(map(self.known.get, parts))
        places = [i for i, f in enumerate(found) if f is None]
        for letters in (True, False):
            kind = [i for i in places if parts[i].isalpha() == letters]
            for at in range(0, len(kind), 1000):
                some = kind[at : at + 1000]
                for i, raw in zip(some, self._encode([parts[i] for i in some], letters)):
                    found[i] = raw
        if len(self.known) < _KNOWN:
            self.known.update((parts[i], found[i]) for i in places)
        return found

    def _encode(self, parts: list[str], letters: bool) -> list[bytes]:
        """The ids of each part.

        Parts of letters alone are one word each to the tokenizer, and it takes many of them as one
        text; if it still counts another number of words, each is encoded by itself.
        """
        if letters:
            whole = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
            cuts = np.searchsorted(whole.word_ids, np.arange(len(parts) + 1))
            if len(whole.word_ids) and whole.word_ids[-1] == len(parts) - 1:
                ids = array("I", whole.ids)
                return [ids[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text begins and the last one ends."""
        words = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        numbered = words.flatten().dictionary_encode()
        halves = [half.dictionary_encode() for half in _halves(numbered.dictionary)]
        pools = [self._found(half.dictionary.to_pylist()) for half in halves]
        pool = np.frombuffer(b"".join([b"".join(p) for p in pools]), dtype=np.uint32)
        length = np.array([len(p) for half in pools for p in half], dtype=np.int64) // 4
        first = np.cumsum(length) - length
        # Each word as two runs of the pool: its stem's and its marks'.
        stem, marks = (half.indices.to_numpy() for half in halves)
        both = np.stack([stem, marks + np.int32(len(pools[0]))], axis=1)[numbered.indices.to_numpy()].ravel()
        size = length[both]
        end = np.cumsum(size, dtype=np.int64)
        place = np.repeat(first[both] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        return pool[place], np.append(0, end)[2 * offsets]


def _halves(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Stem and marks of each word; the marks are empty where a word must be tokenized as a whole."""
    special = pc.match_substring(words, "<|")  # may hold a special token, where case counts
    lower = pc.ascii_lower(words)
    stem = pc.ascii_rtrim(lower, characters=_MARKS)
    parted = pc.and_(pc.not_equal(stem, lower), pc.and_(pc.match_substring_regex(stem, r"\pL$"), pc.invert(special)))
    marks = pc.struct_field(pc.extract_regex(lower, r"(?P<marks>[.,;:!?%$#&*]*)$"), "marks")
    return pc.if_else(parted, stem, pc.if_else(special, words, lower)), pc.if_else(parted, marks, "")


_LOADED: dict[str, Tokens] = {}


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Tokens(path)
        tokens = _LOADED[path]
        end = END.to_bytes(4, "little")
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = []
                ids, cuts = tokens.ids(piece.column("text"))
                cuts = cuts.tolist()
                for i, (doc_id, row) in enumerate(zip(piece.column("doc_id").to_pylist(), piece.column("row").to_pylist())):
                    raw = memoryview(ids[cuts[i] : cuts[i + 1]].tobytes() + end)
                    total = len(raw) // 4
                    for start in range(0, total, capacity):
                        part = raw[4 * start : 4 * (start + capacity)]
                        rows.append((row, doc_id, start, len(part) // 4, zlib.crc32(part), total))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class FreeSpace:
    """Free space of ``n`` sequences; finds the first with enough in logarithmic time."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Take the space; the sequence's number and the free space it had."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < length:
                at += 1
        sequence, free = at - self.leaves, best[at]
        best[at] = free - length
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return sequence, free


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Sequence and offset for each length; lengths must not exceed the capacity."""
    free = FreeSpace(len(lengths), capacity)
    found: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        sequence, had = free.place(lengths[i])
        found[i] = (sequence, capacity - had)
    return found


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "start"], ascending=[False, True, True])
        placed = first_fit_decreasing(group["length"].tolist(), capacity)
        number = int(group["_group"].iloc[0]) << 32
        group["sequence_id"] = [number + s for s, _ in placed]
        group["offset"] = [o for _, o in placed]
        return group.drop(columns="_group")

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = 4096, seed: int = 11) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and row).

    Every row of ``docs`` is a document of its own, which ``row`` tells apart; a null or empty
    text has the end id alone.  No sequence is longer than the capacity and no id is left out.
    A very long text gives many pieces; other columns are not read, and an empty table gives no row.
    """
    quiet_shuffles(docs.sparkSession)
    small_batches(docs.sparkSession)
    schema = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    cut = cut_lineage(
        docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).mapInArrow(_pieces(tokenizer, capacity), schema)
    )
    groups = max(1, -(-cut.count() // group))
    drawn = F.pmod(F.xxhash64("row", "start", F.lit(seed)), F.lit(groups))
    return (
        cut.withColumn("_group", drawn).groupBy("_group")
        .applyInPandas(_pack(capacity), schema + ", sequence_id long, offset long")
    )
