"""Language identification by the nearest of several TF-IDF centroids per language.

A text is lower-cased, everything but letters becomes a space, and its byte trigrams are
counted in a fixed number of hashed places.  Counts are damped by a logarithm, weighted
with the inverse document frequency over all training documents and scaled to unit
length.  Each language's training vectors are clustered (spherical k-means); a document
takes the language of the centroid with the largest cosine.

Rejection is by distance: a text whose cosine to the nearest centroid lies under half of
the least cosine seen among training texts of its length class is foreign to all learned
languages, and so is a text without any letter.

Frequencies, clusters and distances are all fitted on every training document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import add_blocks, block_rows, quiet_shuffles, small_batches
from llm.words import SMALL_PIECE, pieces

PLACES = 1 << 13
PIECE_ROWS = 256
LENGTH_CLASSES = 24  # by the logarithm of the number of trigrams
UNKNOWN = "und"

_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # PLACES
    centroids: np.ndarray  # PLACES x (languages * clusters)
    clusters: int
    least: np.ndarray  # least accepted cosine per length class


def trigram_counts(texts: pa.Array) -> np.ndarray:
    """Rows by hashed places: how often each trigram occurs in each text."""
    texts = pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.empty(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    data = _CLASS[data].astype(np.uint32)
    offsets = offsets - offsets[0]
    n = len(data) - 2
    if n <= 0:
        return np.zeros((len(texts), PLACES), dtype=np.float32)
    code = (data[:n] << np.uint32(16)) | (data[1 : n + 1] << np.uint32(8)) | data[2:]
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    good = (row[:n] == row[2:]) & (code != 0x202020)
    place = (code[good] * np.uint32(2654435761)) >> np.uint32(19)
    counts = np.bincount(row[:n][good] * PLACES + place, minlength=len(texts) * PLACES)
    return counts.reshape(len(texts), PLACES).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return vectors / np.maximum(length, 1e-12)


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + counts.sum(axis=1)).astype(np.int64), LENGTH_CLASSES - 1)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", SMALL_PIECE):
            for at in range(0, len(piece), PIECE_ROWS):
                yield piece.slice(at, PIECE_ROWS)


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(PLACES, dtype=np.int64)
    for piece in _small(batches):
        total += (trigram_counts(piece.column("text")) > 0).sum(axis=0)
    yield block_rows(total, PLACES)


# Unit vectors are summed as whole numbers of this many steps: below 2 ** 53 their order does not matter.
STEPS = 1 << 24


def _step(model: Model, first: bool, last: bool):
    """Sums of the unit vectors per centroid; in the last pass the least cosine per length class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(model.languages) * model.clusters, PLACES)
        sums, least = np.zeros(shape), np.full(LENGTH_CLASSES, 2.0)
        place = {name: i for i, name in enumerate(model.languages)}
        for piece in _small(batches):
            counts = trigram_counts(piece.column("text"))
            vectors = weighted(counts, model.idf)
            known = np.array([place[x] for x in piece.column("lang").to_pylist()], dtype=np.int64)
            if first:
                cluster = known * model.clusters + np.array(piece.column("start").to_pylist())
            else:
                cosine = vectors @ model.centroids
                own = np.arange(shape[0])[None] // model.clusters == known[:, None]
                cluster = np.where(own, cosine, -1).argmax(axis=1)
                if last:
                    lengths = counts.sum(axis=1)
                    np.minimum.at(least, _length_class(counts)[lengths > 0], cosine.max(axis=1)[lengths > 0])
            for k in np.unique(cluster):
                sums[k] += np.rint(vectors[cluster == k] * STEPS).sum(axis=0, dtype=np.float64)
        if last:
            yield block_rows(2.0 - least, LENGTH_CLASSES, cluster=0)
        else:
            for k in np.flatnonzero(sums.any(axis=1)):
                yield block_rows(sums[k], PLACES, cluster=int(k))

    return run


def train(docs: DataFrame, clusters: int = 3, rounds: int = 4) -> Model:
    """Learn from all of ``doc_id, text, lang``; rows without text or lang are left out."""
    quiet_shuffles(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counted = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counted:
        return Model([], np.ones(PLACES, np.float32), np.zeros((PLACES, 0), np.float32), clusters, np.zeros(LENGTH_CLASSES))
    found = add_blocks(docs.select("text").mapInArrow(_count_documents, "block long, counts binary"), "<i8").collect()
    documents = sum(counted.values())
    often = np.frombuffer(found[0]["counts"], dtype="<i8") if found else np.zeros(PLACES)
    idf = (np.log((1 + documents) / (1 + often)) + 1).astype(np.float32)
    drawn = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(7)), F.lit(1_000_003))
    learned = docs.select("text", "lang", F.pmod(drawn, F.lit(clusters)).alias("start"))
    model = Model(sorted(counted), idf, np.zeros((PLACES, len(counted) * clusters), np.float32), clusters, np.zeros(LENGTH_CLASSES))
    for turn in range(rounds):
        parts = add_blocks(
            learned.mapInArrow(_step(model, turn == 0, False), "block long, counts binary, cluster long"), "<f8", ("cluster",)
        ).collect()
        centroids = np.zeros_like(model.centroids)
        for r in parts:
            one = np.frombuffer(r["counts"], dtype="<f8")
            centroids[:, r["cluster"]] = one / max(np.sqrt((one**2).sum()), 1e-12)
        model.centroids = centroids
    tasks = learned.mapInArrow(_step(model, False, True), "block long, counts binary, cluster long")
    least = np.full(LENGTH_CLASSES, 2.0)
    for r in tasks.collect():
        least = np.minimum(least, 2.0 - np.frombuffer(r["counts"], dtype="<f8"))
    seen = least[least < 2]
    model.least = 0.5 * np.where(least < 2, least, seen.min() if len(seen) else 0)
    return model


ADDED = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: Model, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """The documents, all columns, with lang_pred, score (0 to 1) and rejected added in the same pass.

    A null text and one without a letter get ``und``, score 0, rejected.  Every other text
    gets its nearest language, rejected or not; with no language learned all get ``und``.
    Columns of the input with one of the three names are replaced; ``added`` gives other names.
    """
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", *(F.lit(value).alias(name) for name, value in zip(added, ("", 0.0, True)))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for piece in _small(batches):
            texts = piece.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            counts = trigram_counts(texts)
            if known.languages:
                cosine = weighted(counts, known.idf) @ known.centroids
                best = cosine.argmax(axis=1)
                score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
                names = [known.languages[b // known.clusters] if x else UNKNOWN for b, x in zip(best, letters)]
                far = score < known.least[_length_class(counts)]
            else:
                names, score, far = [UNKNOWN] * len(piece), np.zeros(len(piece)), np.ones(len(piece), bool)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(names), pa.array(np.where(letters, score, 0.0)), pa.array(far | ~letters)],
                [*piece.schema.names, *added],
            )

    return docs.mapInArrow(run, schema)


def fold() -> Column:
    """Remainder by five of the checksum of the id's text; 0 is held out of training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def identify(docs: DataFrame, **training) -> DataFrame:
    """``predict`` with a model of the documents that are not held out; held_out is false for a null id."""
    held = docs.select("*", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"))
    return predict(held, train(docs.where(fold() != 0), **training))
