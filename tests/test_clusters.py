"""Training of clusters: first centres from all rows, full batches, mini-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.operators.clusters import (
    as_clustering,
    batch_number,
    cluster_sums,
    farthest_rows,
    full_batch,
    mini_batches,
    train_clusters,
)
from nearkin.operators.seeding import STEPS, _draw, _uniform, distance_steps, first_centres, owned_rows, recluster, total_cost

K, WIDTH = 12, 16


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(8)
    middles = draw.normal(size=(K, WIDTH))
    # one cluster holds a third of all rows, another a handful
    sizes = [500, 6, *draw.integers(40, 160, K - 2)]
    rows = np.concatenate([m + 0.25 * draw.normal(size=(n, WIDTH)) for m, n in zip(middles, sizes)])
    return rows[draw.permutation(len(rows))].astype(np.float32)


@pytest.fixture(scope="module")
def gallery(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(6)


def unit_of(vectors):
    vectors = vectors.astype(float)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cost(vectors, centres):
    return ((unit_of(vectors)[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def plus_plus(vectors, k, seed):
    draw, unit = np.random.default_rng(seed), unit_of(vectors)
    chosen = [unit[draw.integers(len(unit))]]
    while len(chosen) < k:
        far = ((unit[:, None, :] - np.array(chosen)[None]) ** 2).sum(axis=2).min(axis=1)
        chosen.append(unit[draw.choice(len(unit), p=far / far.sum())])
    return np.array(chosen)


def test_first_centres_cost_no_more_than_centres_drawn_one_by_one(gallery, vectors):
    whole = np.mean([cost(vectors, plus_plus(vectors, K, s)) for s in range(20)])
    for seed in (1, 42):
        assert cost(vectors, first_centres(gallery, K, seed)) <= 1.05 * whole


def test_first_centres_do_not_depend_on_partitioning(gallery):
    first, second = first_centres(gallery, K, 7), first_centres(gallery.coalesce(1), K, 7)
    assert first.shape == (K, WIDTH) and np.array_equal(first, second)


def test_every_row_takes_part(spark, gallery, vectors):
    """Rows are drawn where they lie: no limit, no merging into one task."""
    centres = first_centres(gallery, K, 3)
    drawn = _draw(gallery.withColumn("draw", _uniform(3, 0)), centres, 1.0)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Limit", "Sort", "Repartition false")) and drawn.count() == len(vectors)
    assert total_cost(gallery.select("id", "embedding"), centres) == pytest.approx(cost(vectors, centres) * STEPS, rel=1e-5)
    assert owned_rows(gallery.select("id", "embedding"), centres).sum() == len(vectors)


def test_few_different_vectors(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 2.0]) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    assert sorted(first_centres(frame, 5, 1).round(6).tolist()) == [[0.0, 1.0], [1.0, 0.0]]
    none = frame.where("id < 0")
    assert len(first_centres(none, 5, 1)) == 0
    for method in ("full", "mini_batch"):
        trained = train_clusters(none, 5, method=method)
        assert trained.centroids.count() == 0 and trained.label(frame).where("cluster_id is not null").count() == 0
    with pytest.raises(ValueError, match="no training method"):
        train_clusters(frame, 2, method="other")


def test_recluster_weights():
    points = np.array([[0.0], [1.0], [10.0], [11.0]])
    found = recluster(points, np.array([1000, 1, 1, 1000]), 2, 1)
    assert sorted(found.round(2).ravel().tolist()) == [0.0, 11.0]
    assert len(recluster(points, np.array([1, 0, 1, 0]), 3, 1)) == 2


def test_mini_batches_come_near_full_batches(gallery, vectors):
    start = first_centres(gallery, K, 42)
    full, mini = full_batch(gallery, start), mini_batches(gallery, start, batch_rows=128)
    assert cost(vectors, mini) <= 1.05 * cost(vectors, full)
    assert np.array_equal(mini, mini_batches(gallery.coalesce(2), start, batch_rows=128))


def test_batches_cover_all_rows_once(gallery, vectors):
    batches = gallery.select(batch_number(7, 42, 0).alias("b")).groupBy("b").count().collect()
    assert {r["b"] for r in batches} == set(range(7)) and sum(r["count"] for r in batches) == len(vectors)
    assert gallery.where(batch_number(7, 42, 0) != batch_number(7, 42, 1)).count() > len(vectors) // 2
    assert gallery.select(batch_number(1, 42, 0).alias("b")).distinct().collect()[0]["b"] == 0


def test_one_batch_is_one_full_step(gallery, vectors):
    start = first_centres(gallery, K, 5)
    once = mini_batches(gallery, start, batch_rows=10 * len(vectors), starved=0.0)
    assert np.allclose(once, full_batch(gallery, start, iterations=1), atol=1e-12)


def test_a_starved_centre_moves_to_far_rows(gallery, vectors):
    start = first_centres(gallery, K, 42)
    start[4] = -10 * start.mean(axis=0)  # nothing is near it
    left = mini_batches(gallery, start, batch_rows=128, starved=0.0)
    assert np.array_equal(left[4], start[4])
    moved = mini_batches(gallery, start, batch_rows=128)
    assert owned_rows(gallery.select("id", "embedding"), moved)[4] > 0 and cost(vectors, moved) < cost(vectors, left)


def test_farthest_rows_and_sums(gallery, vectors):
    centres = first_centres(gallery, K, 42)
    owner, far = distance_steps(unit_of(vectors), centres)
    got = farthest_rows(gallery, centres)
    assert [r["far"] for r in got] == sorted((r["far"] for r in got), reverse=True)
    for r in got:
        assert abs(r["far"] - far[owner == r["cluster_id"]].max()) <= 2 and owner[r["id"]] == r["cluster_id"]
    total, count = cluster_sums(gallery.select("embedding"), centres)
    assert np.array_equal(count, np.bincount(owner, minlength=K))
    for c in range(K):
        assert np.allclose(total[c] / STEPS, unit_of(vectors)[owner == c].sum(axis=0), atol=1e-4)


def test_a_filter_on_the_batch_reads_its_folder_only(spark, gallery):
    from nearkin.session import cut_lineage

    placed = cut_lineage(gallery.withColumn("_batch", batch_number(4, 1, 0)), by="_batch")
    plan = placed.where(F.col("_batch") == 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_batch" in plan
    assert placed.count() == gallery.count()


def test_labels_follow_the_trained_centres(spark, gallery, vectors):
    centres = full_batch(gallery, first_centres(gallery, K, 42))
    labels = {r["id"]: r["cluster_id"] for r in as_clustering(spark, centres, WIDTH).label(gallery).collect()}
    owner = distance_steps(unit_of(vectors), centres)[0]
    assert all(labels[i] == owner[i] for i in range(len(vectors)))
