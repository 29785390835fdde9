"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its ``prefix`` nearest of a set of pivots, in order.  Blocks of
the table post these in inverted files, one list of (row, place) per pivot.  A query collects
the lists of its own pivots; a pivot at places i and j of two prefixes lowers their footrule
distance by ``2 * (prefix - max(i, j))``, so the sums rank the block's rows by footrule
distance.  The nearest ``share`` of each block is then measured exactly.

Nearness is the inner product.  One extra coordinate makes all stored vectors equally long,
which turns the largest inner product into the smallest distance for pivots and vectors of any length.

Pivots are a sample of ``pivots`` vectors by a hash of their ids; every row is indexed.
Queries and rows are packed in blocks of bounded size, each pair of blocks is one unit of
work, and its packed lists of best rows are merged in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut_lineage, quiet_shuffles

ROWS, QUERIES = 1024, 256  # per block
MOST_WIDTHS = 16

_PACKED = "block long, ids binary, vectors binary, places binary"
_HIT = np.dtype([("query", "<i8"), ("id", "<i8"), ("score", "<f8")])


def nearest_pivots(vectors: np.ndarray, extra: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first; pivots carry the extra coordinate last."""
    wide = np.concatenate([vectors, extra[:, None]], axis=1)
    near = wide @ pivots.T - 0.5 * (pivots**2).sum(axis=1)
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.uint16)


def _pack(pivots: np.ndarray, prefix: int, longest: float, stored: bool):
    def run(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for part in parts:
            ids.extend(part.column("id").to_pylist())
            vectors.append(np.array(part.column("vector").flatten()).reshape(len(part), -1))
        ids, vectors = np.array(ids, dtype="<i8"), np.concatenate(vectors)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        extra = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0)) if stored else np.zeros(len(ids))
        places = nearest_pivots(vectors, extra, pivots, prefix)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, places))],
            ["block", "ids", "vectors", "places"],
        )

    return run


def footrule_gains(queries: np.ndarray, rows: np.ndarray, pivots: int) -> np.ndarray:
    """Half of what the pivots in common take off the footrule distance, for every query and row of two blocks.

    A pivot's list holds for each row of the block ``prefix`` less its place, or 0 if the row is
    not posted there; a query adds up the lists of its own pivots.
    """
    prefix = rows.shape[1]
    weights = np.arange(prefix, 0, -1).astype(np.uint16)
    kind = np.uint16 if prefix * (prefix + 1) // 2 < 1 << 16 else np.uint32
    lists = np.zeros((pivots, len(rows)), dtype=kind)
    lists[rows.ravel(), np.repeat(np.arange(len(rows)), prefix)] = np.tile(weights, len(rows))
    gains = np.empty((len(queries), len(rows)), dtype=kind)
    for q, places in enumerate(queries):
        own = lists[places]
        np.minimum(own, weights[:, None], out=own)
        np.add.reduce(own, axis=0, out=gains[q])
    return gains


def _best(hits: np.ndarray, k: int) -> np.ndarray:
    """The k best hits of each query, ordered by query, score and id."""
    hits = hits[np.lexsort((hits["id"], -hits["score"], hits["query"]))]
    first = np.append(True, hits["query"][1:] != hits["query"][:-1]) if len(hits) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0)) if len(hits) else np.empty(0, int)
    return hits[np.arange(len(hits)) - start < k]


def measured_rows(
    queries: np.ndarray, rows: np.ndarray, near: np.ndarray, valid: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of queries and rows to measure exactly: all but near rows that rounding cannot bring among the k best."""
    products = np.where(valid, np.take_along_axis(queries @ rows.T, near, axis=1), -np.inf)
    least = np.partition(products, -k, axis=1)[:, -k] if products.shape[1] > k else np.full(len(queries), -np.inf)
    lengths = np.sqrt((queries**2).sum(axis=1)) * np.sqrt((rows**2).sum(axis=1).max())
    slack = 4 * rows.shape[1] * np.finfo(np.float64).eps * lengths
    floor = least - slack
    floor[~np.isfinite(floor)] = -np.inf
    q, at = np.nonzero(valid & (products >= floor[:, None]))
    return q, near[q, at]


def _search(pivots: int, prefix: int, k: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                qid, rid = (np.frombuffer(row[c], "<i8") for c in ("q_ids", "ids"))
                qv, rv = (np.frombuffer(row[c], "<f8").reshape(len(i), -1) for c, i in (("q_vectors", qid), ("vectors", rid)))
                qp, rp = (np.frombuffer(row[c], np.uint16).reshape(len(i), -1) for c, i in (("q_places", qid), ("places", rid)))
                gains = footrule_gains(qp, rp, pivots).astype(np.int64)
                wanted = min(len(rid), max(2 * k + 1, int(np.ceil(share * len(rid)))))
                rank = gains * len(rid) + np.arange(len(rid))[::-1]  # rows lie in order of id
                near = np.argpartition(-rank, wanted - 1, axis=1)[:, :wanted] if wanted < len(rid) else np.tile(np.arange(len(rid)), (len(qid), 1))
                q, r = measured_rows(qv, rv, near, rid[near] != qid[:, None], k)
                hits = np.empty(len(q), dtype=_HIT)
                hits["query"], hits["id"], hits["score"] = qid[q], rid[r], (rv[r] * qv[q]).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["q_block"]], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([_best(hits, k).tobytes()], pa.binary())],
                    ["q_block", "block", "hits"],
                )

    return run


def _merge(k: int):
    def run(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.empty(0, dtype=_HIT)
        for part in parts:
            for raw in part.column("hits"):
                best = _best(np.concatenate([best, np.frombuffer(raw.as_buffer(), _HIT)]), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([best.tobytes()], pa.binary())], ["q_block", "hits"]
        )

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("hits"):
            hits = np.frombuffer(raw.as_buffer(), _HIT)
            first = np.append(True, hits["query"][1:] != hits["query"][:-1]) if len(hits) else np.empty(0, bool)
            start = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0)) if len(hits) else np.empty(0, int)
            rank = (np.arange(len(hits)) - start + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hits["query"]), pa.array(rank), pa.array(hits["id"]), pa.array(hits["score"])],
                ["query_id", "rank", "vec_id", "score"],
            )


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``id, vector`` (doubles) of the rows that take part.

    Left out are rows without id and vectors that are null, empty or zero or hold a null or
    non-finite component.  Of rows with one id the least vector counts.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector")).where(
        "id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x != 0)"
    )
    return cut_lineage(rows.groupBy("id").agg(F.min("vector").alias("vector")))


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = 256, prefix: int = 96, share: float = 0.2, seed: int = 3,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for every row whose id is divisible by ``every``.

    Ties go to the smaller id.  A table without usable rows gives no row.  Vectors of different widths
    have no inner product: each width is searched by itself, and more than ``MOST_WIDTHS`` are an error.
    """
    quiet_shuffles(vectors.sparkSession)
    rows = usable(vectors)
    widths = [r["w"] for r in rows.select(F.size("vector").alias("w")).distinct().limit(MOST_WIDTHS + 1).collect()]
    if len(widths) > MOST_WIDTHS:
        raise ValueError(f"vectors of more than {MOST_WIDTHS} widths")
    found = [_nearest(rows.where(F.size("vector") == w), every, k, pivots, prefix, share, seed) for w in sorted(widths)]
    return reduce(DataFrame.unionByName, found) if found else _nearest(rows, every, k, pivots, prefix, share, seed)


def _nearest(rows: DataFrame, every: int, k: int, pivots: int, prefix: int, share: float, seed: int) -> DataFrame:
    """The search among rows of one width."""
    longest, count, asked = rows.agg(
        F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))), F.count("*"), F.count_if(F.col("id") % every == 0)
    ).first()
    drawn = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(pivots).collect()
    chosen = np.array([r["vector"] for r in drawn]) if drawn else np.zeros((1, 1))
    extra = np.sqrt(np.maximum((longest or 0.0) ** 2 - (chosen**2).sum(axis=1), 0))
    chosen = np.concatenate([chosen, extra[:, None]], axis=1)
    prefix = min(prefix, len(chosen))
    blocks, asking = -(-count // ROWS) or 1, -(-asked // QUERIES) or 1

    def packed(frame: DataFrame, number: int, stored: bool) -> DataFrame:
        placed = frame.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(number)))
        return cut_lineage(placed.groupBy("block").applyInArrow(_pack(chosen, prefix, longest or 0.0, stored), _PACKED))

    index = packed(rows, blocks, True)
    queries = packed(rows.where(F.col("id") % every == 0), asking, False).select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("places").alias("q_places"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )
    pairs = queries.join(index, "block")
    found = pairs.mapInArrow(_search(len(chosen), prefix, k, share), "q_block long, block long, hits binary")
    slots = max(1, int(blocks**0.5))
    part = found.withColumn("slot", F.pmod("block", F.lit(slots))).groupBy("q_block", "slot").applyInArrow(_merge(k), "q_block long, hits binary")
    whole = part.groupBy("q_block").applyInArrow(_merge(k), "q_block long, hits binary")
    return whole.mapInArrow(_rows, "query_id long, rank int, vec_id long, score double")
