"""First centres for k-means over all rows: oversampling rounds, then weighted reclustering.

Each round measures every row against the candidates so far and draws rows in proportion to
their squared distance.  Distances are whole numbers of steps, so their sum is exact, and a row is
drawn by a hash of its id; the candidates therefore do not depend on how rows are partitioned.
A round sends one number per task, then the rows drawn, about ``OVERSAMPLING * k`` whatever the
size of the table.  The candidates, weighted by the rows nearest to them, are clustered last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.operators.nearest import MERGED_LISTS
from nearkin.operators.topk import to_matrix

# Unit vectors and distances are summed as whole numbers of this many steps, which is finer
# than their single-precision source.  Whole sums do not depend on the order of rows.
STEPS = 1 << 24
ROUNDS, OVERSAMPLING = 5, 2
STARTS, REFINEMENTS = 4, 50  # of the reclustering, which sees candidates only


def unit_rows(column: pa.Array) -> np.ndarray:
    vectors = to_matrix(column)
    if not len(vectors):
        return vectors
    length = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors / np.where(length > 1e-12, length, 1.0)[:, None]


def distance_steps(unit: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest centre and the squared distance to it, in whole steps."""
    gain = unit @ centres.T - (centres * centres).sum(axis=1) / 2
    owner = gain.argmax(axis=1)
    far = (unit * unit).sum(axis=1) - 2 * gain[np.arange(len(unit)), owner]
    return owner, np.rint(np.maximum(far, 0) * STEPS).astype(np.int64)


def first_centres(gallery: DataFrame, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` centres; fewer if there are fewer different vectors, none for an empty gallery.

    ``gallery`` has ``id`` and ``embedding``, none of them null.
    """
    rows = gallery.select("id", "embedding")
    start = rows.agg(F.min(F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), "id", "embedding")).alias("r")).first()["r"]
    if start is None:
        return np.zeros((0, 0))
    known = unit_rows(pa.array([start["embedding"]], pa.list_(pa.float64())))
    for turn in range(rounds):
        cost = total_cost(rows, known)
        if not cost:
            break
        drawn = _draw(rows.withColumn("draw", _uniform(seed, turn)), known, OVERSAMPLING * k / cost).toArrow()
        if drawn.num_rows:
            drawn = drawn.sort_by("id")
            known = np.concatenate([known, to_matrix(drawn.column("unit"))])
    return recluster(known, owned_rows(rows, known), k, seed)


def total_cost(rows: DataFrame, centres: np.ndarray) -> int:
    """The sum of all squared distances to the nearest centre, in steps."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if len(batch):
                total += int(distance_steps(unit_rows(batch.column(0)), shared.value)[1].sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["cost"])

    costs = rows.select("embedding").coalesce(MERGED_LISTS).mapInArrow(run, "cost long")
    return int(costs.agg(F.sum(F.col("cost").cast("decimal(38,0)"))).first()[0] or 0)


def owned_rows(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """How many rows are nearest to each centre."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            if len(batch):
                counts += np.bincount(distance_steps(unit_rows(batch.column(0)), shared.value)[0], minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["at", "n"])

    found = rows.select("embedding").coalesce(MERGED_LISTS).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(centres), np.int64)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return counts


def _uniform(seed: int, turn: int) -> Column:
    """A number from 0 to below 1 that the row's id decides."""
    return F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(turn)), 11) / F.lit(float(1 << 53))


def _draw(rows: DataFrame, known: np.ndarray, rate: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                unit = unit_rows(batch.column("embedding"))
                far = distance_steps(unit, shared.value)[1]
                at = np.flatnonzero(batch.column("draw").to_numpy() < rate * far)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.array(list(unit[at]), pa.list_(pa.float64()))], names=["id", "unit"]
                )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, unit array<double>")


def recluster(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means of the candidates: the cheapest of a few seeded starts."""
    points, weights = points[weights > 0], weights[weights > 0].astype(np.float64)
    if len(points) <= k:
        return points
    found = [_weighted_means(points, weights, _spread(points, weights, k, np.random.default_rng([seed, s]))) for s in range(STARTS)]
    return min(found, key=lambda x: x[0])[1]


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    far = (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)
    return np.maximum(far, 0)


def _spread(points: np.ndarray, weights: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """Centres drawn one by one in proportion to weight and squared distance to those before."""
    chosen = [int(draw.choice(len(points), p=weights / weights.sum()))]
    least = _squared(points, points[chosen])[:, 0]
    while len(chosen) < k:
        share = weights * least
        if not share.sum():
            break
        chosen.append(int(draw.choice(len(points), p=share / share.sum())))
        least = np.minimum(least, _squared(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _weighted_means(points: np.ndarray, weights: np.ndarray, centres: np.ndarray) -> tuple[float, np.ndarray]:
    for _ in range(REFINEMENTS):
        owner = _squared(points, centres).argmin(axis=1)
        held = np.zeros((len(centres), len(points)))
        held[owner, np.arange(len(points))] = weights
        total = held.sum(axis=1)
        moved = np.where(total[:, None] > 0, held @ points / np.maximum(total, 1e-300)[:, None], centres)
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return float((weights * _squared(points, centres).min(axis=1)).sum()), centres
