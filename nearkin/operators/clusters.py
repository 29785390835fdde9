"""Spherical k-means over the gallery."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from nearkin.functions.vectors import as_double, l2_normalize
from nearkin.operators import seeding
from nearkin.operators.means import vector_mean
from nearkin.operators.nearest import MERGED_LISTS, WIDEST_VECTOR, append_nearest
from nearkin.operators.seeding import STEPS, distance_steps, first_centres, unit_rows
from nearkin.session import cut_lineage

# Ship the arithmetic inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(seeding)

METHODS = ("full", "mini_batch")
# Mini-batches of one epoch; with more rows the batches grow, so that steps stay few.
MOST_BATCHES = 256
# A centre with less than this share of the rows of the largest is starved.
STARVED = 0.01


@dataclass(frozen=True)
class Clustering:
    centroids: DataFrame  # cluster_id, centroid of unit length
    trained: DataFrame  # cluster_id, centre as trained: a mean, shorter than one
    width: int

    def label(self, rows: DataFrame, row_id: str = "id") -> DataFrame:
        """Rows with the ``cluster_id`` of the nearest centre as trained; no shuffle."""
        unit = rows.drop("cluster_id").withColumn("_unit", l2_normalize(as_double("embedding")))
        found = append_nearest(
            unit, self.trained.withColumnRenamed("centroid", "embedding"), 1, "euclidean", "_near",
            label="cluster_id", row_id=row_id, vector="_unit", width=self.width,
        )
        return found.withColumn("cluster_id", F.get("_near", F.lit(0))).drop("_near", "_unit")


def train_clusters(
    gallery: DataFrame, k: int = 256, seed: int = 42, iterations: int = 20, tolerance: float = 1e-4,
    width: int = WIDEST_VECTOR, method: str = "full", batch_rows: int = 2048,
) -> Clustering:
    """K-means on normalised vectors, full-batch or in mini-batches.

    First centres come from all rows (``seeding``).  A full-batch step reads all vectors where
    they lie and returns one sum per cluster and task.  Mini-batches lay the vectors out once,
    by batch, and then read each of them once per epoch.  Draws go by hashes of ids and sums are
    exact, so the result does not depend on how the gallery is partitioned.

    Labels come from the centres as trained; the stored centres are scaled to
    unit length afterwards.
    """
    if method not in METHODS:
        raise ValueError(f"no training method {method!r}; choose from {', '.join(METHODS)}")
    present = gallery.where(F.col("embedding").isNotNull())
    centres = first_centres(present, k, seed)
    if method == "full":
        centres = full_batch(present, centres, iterations, tolerance)
    else:
        centres = mini_batches(present, centres, batch_rows, seed)
    return as_clustering(gallery.sparkSession, centres, width)


def as_clustering(spark: SparkSession, centres: np.ndarray, width: int = WIDEST_VECTOR) -> Clustering:
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    trained = spark.createDataFrame(rows, "cluster_id int, centroid array<double>")
    unit = trained.withColumn("centroid", l2_normalize(F.col("centroid")))
    return Clustering(unit, trained, width)


def full_batch(gallery: DataFrame, centres: np.ndarray, iterations: int = 20, tolerance: float = 1e-4) -> np.ndarray:
    """Move every centre to the mean of its rows until no element moves more than ``tolerance``."""
    points = gallery.select("embedding")
    for _ in range(iterations if len(centres) else 0):
        moved = _step(points, centres)
        shift = np.abs(moved - centres).max(initial=0.0)
        centres = moved
        if shift <= tolerance:
            break
    return centres


def batch_number(batches: int, seed: int, epoch: int, key: str = "id") -> Column:
    """The batch of a row: the range in which the first 32 bits of a digest of seed, epoch and id lie."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(key).cast("string")))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * F.lit(batches), 32).cast("int")


def mini_batches(
    gallery: DataFrame, centres: np.ndarray, batch_rows: int = 2048, seed: int = 42, epochs: int = 1,
    most_batches: int = MOST_BATCHES, starved: float = STARVED,
) -> np.ndarray:
    """Move centres batch by batch, each towards the mean of its rows of the batch.

    A centre's learning rate is the share that the batch has in all rows it has seen.  Every
    row is in one batch of an epoch.  From time to time centres with few rows are put where
    a batch's farthest rows lie, one for each crowded centre at most.
    """
    if not len(centres):
        return centres
    rows = gallery.select("id", "embedding")
    number = rows.count()
    batches = max(1, min(most_batches, -(-number // batch_rows)))
    centres, seen, unchecked = centres.copy(), np.zeros(len(centres), np.int64), 0
    for epoch in range(epochs):
        placed = cut_lineage(rows.withColumn("_batch", batch_number(batches, seed, epoch)), by="_batch")
        for batch in range(batches):
            own = placed.where(F.col("_batch") == batch)
            total, count = cluster_sums(own.select("embedding"), centres)
            seen += count
            hit = count > 0
            centres[hit] += (total[hit] / float(STEPS) - count[hit, None] * centres[hit]) / seen[hit, None]
            unchecked += int(count.sum())
            if starved and unchecked >= 10 * len(centres):
                centres, seen, unchecked = *_reseeded(own, centres, seen, starved), 0
    return centres


def _reseeded(rows: DataFrame, centres: np.ndarray, seen: np.ndarray, starved: float) -> tuple[np.ndarray, np.ndarray]:
    few = np.flatnonzero(seen < starved * seen.max())
    if not len(few):
        return centres, seen
    far = farthest_rows(rows, centres)
    far = [r for r in far if r["cluster_id"] not in set(few.tolist())][: len(few)]
    centres, seen = centres.copy(), seen.copy()
    least = seen[np.setdiff1d(np.arange(len(seen)), few)].min()
    for place, row in zip(few[np.argsort(seen[few], kind="stable")], far):
        centres[place], seen[place] = row["unit"], least
    return centres, seen


def farthest_rows(rows: DataFrame, centres: np.ndarray) -> list[Row]:
    """For each centre that has rows the one farthest from it, the farthest of all first; ties go to the larger id."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            unit = unit_rows(batch.column("embedding"))
            owner, far = distance_steps(unit, shared.value)
            ids = batch.column("id").to_numpy()
            order = np.lexsort((-ids, -far, owner))
            best = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[best].astype(np.int32)), pa.array(far[best]), pa.array(ids[best]), pa.array(list(unit[best]), pa.list_(pa.float64()))],
                names=["cluster_id", "far", "id", "unit"],
            )

    found = rows.select("id", "embedding").mapInArrow(run, "cluster_id int, far long, id long, unit array<double>")
    best = found.groupBy("cluster_id").agg(F.max(F.struct("far", "id", "unit")).alias("b")).select("cluster_id", "b.*")
    return sorted(best.where("far > 0").collect(), key=lambda r: (-r["far"], -r["id"]))  # one row per centre


def cluster_sums(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum (in steps) and number of the rows nearest to each centre."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        totals, counts = np.zeros(known.shape, np.int64), np.zeros(len(known), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            unit = unit_rows(batch.column(0))
            owner = distance_steps(unit, known)[0]
            member = np.zeros((len(known), len(unit)))
            member[owner, np.arange(len(unit))] = 1.0
            # Exact: the sum of a batch is a whole number far below 2 ** 53.
            totals += (member @ np.rint(unit * STEPS)).astype(np.int64)
            counts += member.sum(axis=1).astype(np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(counts[used]),
             pa.array(list(totals[used]), pa.list_(pa.int64()))],
            names=["cluster_id", "n", "total"],
        )

    sums = points.coalesce(MERGED_LISTS).mapInArrow(run, "cluster_id int, n long, total array<long>")
    elements = sums.select("cluster_id", "n", F.posexplode("total").alias("pos", "value"))
    merged = elements.groupBy("cluster_id", "pos").agg(F.sum("value").alias("t"), F.sum("n").alias("n"))
    cluster, place, total, count = (c.to_numpy() for c in merged.toArrow().columns)  # k x width rows
    totals, counts = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64)
    totals[cluster, place] = total
    counts[cluster] = count
    return totals, counts


def _step(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The mean of the rows nearest to each centre; a centre without rows stays."""
    total, count = cluster_sums(points, centres)
    return np.where(count[:, None] > 0, total / (np.maximum(count, 1)[:, None] * float(STEPS)), centres)


def assign_clusters(
    rows: DataFrame, centroids: DataFrame, row_id: str = "id", width: int = WIDEST_VECTOR
) -> DataFrame:
    """Set ``cluster_id`` of every row to its nearest centroid, in place of a join.

    Rows without a vector keep a null cluster.
    """
    found = append_nearest(
        rows.drop("cluster_id"), centroids.select("cluster_id", F.col("centroid").alias("embedding")),
        1, "dot", "_nearest", label="cluster_id", row_id=row_id, width=width,
    )
    return found.withColumn("cluster_id", F.get("_nearest", F.lit(0))).drop("_nearest")


def update_clusters(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """Write given ``(id, cluster_id)`` pairs into the rows; others become null."""
    return rows.drop("cluster_id").join(assigned, "id", "left")


def lloyd_step(gallery: DataFrame, centroids: DataFrame) -> DataFrame:
    """Assign every row to its nearest centre, then move the centres; unit length throughout."""
    unit = gallery.select("id", l2_normalize(as_double("embedding")).alias("embedding"))
    means = vector_mean(
        assign_clusters(unit, centroids), ["cluster_id"], "embedding", "centroid"
    )
    return means.withColumn("centroid", l2_normalize(F.col("centroid")))
