"""Removal of repeated passages: exact window counts over super-k-mer partitions.

A window is a run of ``k`` words of one text; its minimiser is the least hash among its runs
of ``m`` words.  Consecutive windows sharing a minimiser travel as one packed string
to the bucket of that minimiser, so two equal windows always meet.  In a bucket the
strings, each with its count, are cut into windows again; sorting brings equal windows
together, and their words are compared before they count as equal.

A minimiser found very often (a line that a third of all texts share) would fill one
bucket with strings that differ around it.  Its windows travel one by one instead, to
buckets of their own hashes.  Which minimisers these are is counted over all texts; there
are at most ``MOST_HOT``, so their list may be broadcast.  Equal strings are counted in the
map tasks, so a group of copies costs one string per task.

The repeated windows come back by a digest of their string; a text is told by its own
digest.  A last pass marks the covered words in the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut_lineage, quiet_shuffles, signed
from llm.words import SMALL_PIECE, SPACES, Words, mix, pieces, split_bytes, split_words

MOST_HOT, LEAST_HOT = 4_000_000, 2_000
BUCKET_STRINGS = 16_000  # about; more make fewer and longer frames, but a task holds a bucket
FLUSH_BYTES = 24 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_PLAIN = np.where(_SPACE, 32, np.arange(256)).astype(np.uint8)


class SuperKmers:
    """Super-k-mers of several texts: windows ``first[i]`` to ``last[i]`` have the minimiser ``value[i]``."""

    def __init__(self, words: Words, k: int, m: int) -> None:
        self.words, self.k = words, k
        ends = words.first[1:] - k + 1  # windows of text t start before this word
        usable = ends > words.first[:-1]
        self.text = np.flatnonzero(usable)
        self.first = self.last = np.empty(0, np.int64)
        self.value = np.empty(0, np.uint64)
        if not len(self.text):
            return
        width, have = k - m + 1, 1
        least = words.grams(m)
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        begins, ends = words.first[:-1][usable], ends[usable]
        new = np.ones(len(least), dtype=bool)
        new[1:] = least[1:] != least[:-1]
        new[begins] = True
        inside = np.zeros(len(least) + 1, dtype=np.int64)
        np.add.at(inside, begins, 1)
        np.add.at(inside, ends, -1)
        inside = np.cumsum(inside[:-1]) > 0
        self.first = np.flatnonzero(new & inside)
        following = np.append(self.first[1:], len(least))
        self.last = np.minimum(following, ends[np.searchsorted(begins, self.first, side="right") - 1]) - 1
        self.value = mix(least[self.first])

    def split_hot(self, hot: np.ndarray) -> None:
        """Let the windows of hot minimisers stand alone, each under its own hash."""
        if not len(hot) or not len(self.value):
            return
        place = np.minimum(np.searchsorted(hot, self.value), len(hot) - 1)
        found = hot[place] == self.value
        if not found.any():
            return
        count = np.where(found, self.last - self.first + 1, 1)
        each = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        alone = found[each]
        first = self.first[each] + np.where(alone, offset, 0)
        self.last = np.where(alone, first, self.last[each])
        self.first, self.value = first, np.where(alone, mix(self.words.grams(self.k)[first]), self.value[each])

    def strings(self) -> list[bytes]:
        """The words of each super-k-mer, joined by one space."""
        w = self.words
        word = ~_SPACE[w.data]
        kept = word.copy()
        kept[1:] |= word[:-1]  # the first space after a word stays
        raw = _PLAIN[w.data[kept]].tobytes()
        length = w.end - w.start
        place = np.zeros(len(length), dtype=np.int64)
        np.cumsum(length[:-1] + (w.start[1:] > w.end[:-1]), out=place[1:])
        last = self.last + self.k - 1
        begin, end = place[self.first].tolist(), (place[last] + length[last]).tolist()
        return [raw[a:b] for a, b in zip(begin, end)]


def _count_minimisers(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE):
                value, number = np.unique(SuperKmers(split_words(piece.column("text")), k, m).value, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(number)], ["minimiser", "number"])

    return run


def _packed(strings: list[bytes], counts: list[int]) -> bytes:
    head = np.array([len(strings), *map(len, strings), *counts], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(strings))


def _unpacked(raw: bytes) -> Iterator[tuple[bytes, int]]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    lengths, counts = np.frombuffer(raw, "<u4", 2 * n, 4).reshape(2, n).tolist()
    at = 4 + 8 * n
    for length, count in zip(lengths, counts):
        yield raw[at : at + length], count
        at += length


def _send(k: int, m: int, buckets: int, shared):
    def flush(found: dict[bytes, list[int]]) -> pa.RecordBatch:
        by_bucket: dict[int, tuple[list[bytes], list[int]]] = {}
        for string, (bucket, count) in found.items():
            strings, counts = by_bucket.setdefault(bucket, ([], []))
            strings.append(string)
            counts.append(count)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(by_bucket), pa.int64()), pa.array([_packed(*x) for x in by_bucket.values()], pa.binary())], ["bucket", "packed"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[int]] = {}
        held = 0
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE):
                parts = SuperKmers(split_words(piece.column("text")), k, m)
                parts.split_hot(shared.value)
                if not len(parts.value):
                    continue
                for string, bucket in zip(parts.strings(), (parts.value % np.uint64(buckets)).tolist()):
                    if string in found:
                        found[string][1] += 1
                    else:
                        found[string] = [bucket, 1]
                        held += len(string) + 200
                if held > FLUSH_BYTES:
                    yield flush(found)
                    found, held = {}, 0
        yield flush(found)

    return run


def _digest(string: bytes) -> bytes:
    return hashlib.blake2b(string, digest_size=16).digest()


def _parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of strings of about ``SMALL_PIECE`` bytes: arrays of many times that size are made of each."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SMALL_PIECE, side="right")) - 1)
        yield at, to
        at = to


def repeated_windows(strings: dict[bytes, int], k: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Strings with windows that occur more than once, and which of their windows do."""
    ordered = list(strings)
    raw = b"".join(ordered)
    data, offsets = np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, ordered)])
    found = []
    for t, to in _parts(offsets):
        words = split_bytes(data[offsets[t] : offsets[to]], offsets[t : to + 1] - offsets[t])
        at, text, value = words.windows(k)
        found.append((text + t, value, words.start[at] + offsets[t], words.end[at + k - 1] + offsets[t]))
    if not found:
        return
    owner, value, begin, end = map(np.concatenate, zip(*found))
    weight = np.array(list(strings.values()), dtype=np.int64)[owner]
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    run = np.cumsum(np.append(True, ~same)) - 1 if len(order) else order
    times = np.bincount(run, weights=weight[order])
    again = np.zeros(len(order), dtype=bool)
    again[order] = times[run] > 1
    # Windows of one hash but other words would be counted together; their words decide.
    pairs = np.flatnonzero(same)
    a, b = order[pairs], order[pairs + 1]
    differ = [raw[i:j] != raw[p:q] for i, j, p, q in zip(*(x.tolist() for x in (begin[a], end[a], begin[b], end[b])))]
    for r in np.unique(run[pairs[np.array(differ, dtype=bool)]]).tolist():
        members = order[run == r].tolist()
        exact: dict[bytes, int] = {}
        for i in members:
            exact[raw[begin[i] : end[i]]] = exact.get(raw[begin[i] : end[i]], 0) + int(weight[i])
        for i in members:
            again[i] = exact[raw[begin[i] : end[i]]] > 1
    cuts = np.searchsorted(owner, np.arange(len(ordered) + 1))
    for t in np.unique(owner[again]).tolist():
        yield ordered[t], again[cuts[t] : cuts[t + 1]]


def _count(k: int):
    def run(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: dict[bytes, int] = {}
        for part in parts:
            for packed in part.column("packed"):
                for string, count in _unpacked(packed.as_py()):
                    strings[string] = strings.get(string, 0) + count
        rows = [(_digest(s), np.packbits(mask).tobytes()) for s, mask in repeated_windows(strings, k)]
        digest, mask = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(mask, pa.binary())], ["digest", "mask"])

    return run


def _occurrences(k: int, m: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE):
                keys = [hashlib.md5(t.as_buffer()).digest() if t.is_valid else b"" for t in piece.column("text")]
                parts = SuperKmers(split_words(piece.column("text")), k, m)
                parts.split_hot(shared.value)
                if not len(parts.value):
                    continue
                text = np.searchsorted(parts.words.first, parts.first, side="right") - 1
                new = np.zeros(len(keys), dtype=bool)
                for t, key in enumerate(keys):
                    if key not in seen:
                        new[t] = True
                        if len(seen) < 1_000_000:
                            seen.add(key)
                chosen = np.flatnonzero(new[text])
                strings = parts.strings()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(strings[i]) for i in chosen], pa.binary()), pa.array([keys[t] for t in text[chosen]], pa.binary()),
                     pa.array((parts.first - parts.words.first[text])[chosen], pa.int32())],
                    ["digest", "text_key", "start"],
                )

    return run


def _covered(first: np.ndarray, hits: pa.Array, k: int) -> np.ndarray:
    """Which words a repeated window covers; text ``t`` has the words ``first[t]:first[t + 1]`` and in ``hits`` super-k-mers with a bit for each window."""
    change = np.zeros(first[-1] + 1, dtype=np.int64)
    first = np.repeat(first[:-1], pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False))
    hits = hits.flatten()
    first += hits.field("start").to_numpy()
    masks = hits.field("mask").to_pylist()
    begin = np.cumsum([0, *map(len, masks)])
    bits = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(masks), np.uint8)))
    hit = np.searchsorted(begin, bits >> 3, side="right") - 1
    at = first[hit] + bits - 8 * begin[hit]
    np.add.at(change, at, 1)
    np.add.at(change, at + k, -1)
    return np.cumsum(change)[:-1] > 0


def _finish(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", SMALL_PIECE):
                rows, texts = [], []
                words = [text.as_buffer().to_pybytes().split() if text.is_valid else [] for text in piece.column("text")]
                first = np.cumsum([0, *map(len, words)])
                covered = _covered(first, piece.column("hits"), k)
                removed = np.diff(np.append(0, np.cumsum(covered))[first])
                for text, a, lost in zip(words, first.tolist(), removed.tolist()):
                    kept = b" ".join([w for w, c in zip(text, covered[a : a + len(text)].tolist()) if not c] if lost else text)
                    rows.append((len(text), lost, hashlib.sha256(kept).hexdigest()))
                    texts.append(kept.decode())
                n, removed, sha = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(texts, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def repeated_passages(docs: DataFrame, k: int = 35, m: int = 8) -> DataFrame:
    """``text_key, hits``: per distinct text its super-k-mers (first word) with a bit for each repeated window."""
    quiet_shuffles(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    texts = docs.select("text").where("text is not null")
    counted = cut_lineage(
        texts.mapInArrow(_count_minimisers(k, m), "minimiser long, number long")
        .groupBy("minimiser").agg(F.sum("number").alias("number"))
    )
    total = counted.agg(F.sum("number")).first()[0] or 0
    hot = counted.where(F.col("number") > max(LEAST_HOT, total // MOST_HOT)).select("minimiser").toArrow()
    hot = np.sort(hot.column(0).to_numpy().astype(np.int64).view(np.uint64))
    shared = context.broadcast(hot)
    buckets = max(1, -(-total // BUCKET_STRINGS))
    repeats = cut_lineage(
        texts.mapInArrow(_send(k, m, buckets, shared), "bucket long, packed binary")
        .groupBy("bucket").applyInArrow(_count(k), "digest binary, mask binary")
    )
    found = texts.mapInArrow(_occurrences(k, m, shared), "digest binary, text_key binary, start int")
    hits = found.join(repeats, "digest").groupBy("text_key", "start").agg(F.first("mask").alias("mask"))
    return cut_lineage(hits.groupBy("text_key").agg(F.collect_list(F.struct("start", "mask")).alias("hits")))


def remove_repeats(docs: DataFrame, k: int = 35, m: int = 8) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window covers it whose words also start anywhere else.  A null text
    counts as empty; texts of fewer than ``k`` words lose nothing; every copy of a repeated
    row loses all words that a window covers.
    """
    hits = repeated_passages(docs, k, m)
    texts = docs.select("doc_id", "text").withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    return (
        texts.join(hits, "text_key", "left").select("doc_id", "text", "hits")
        .mapInArrow(_finish(k), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )
