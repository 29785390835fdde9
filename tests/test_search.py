"""Searches on hand-made vectors: fallbacks, ties, physical forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import nearkin.operators.nearest as nearest_module
from nearkin.operators.nearest import append_nearest, nearest
from nearkin.operators.ranking import rank_speakers
from nearkin.operators.routing import route_metadata
from nearkin.plans.search import ARCHITECTURES, Enrolled, search, utterance_hits
from nearkin.plans.sweep import aggregations, depths, evaluate, sweep

GALLERY = "id long, speaker_id string, embedding array<double>, cluster_id int"
PROBES = "query_id long, speaker_id string, embedding array<double>"
SPEAKERS = "speaker_id string, gender string, nationality string"
CATEGORIES = "category string, category_value string, centroid array<double>"
CLUSTERS = "cluster_id int, centroid array<double>"


@pytest.fixture
def world(spark):
    gallery = [
        (1, "a", [1.0, 0.0], 0), (2, "b", [0.9, 0.5], 0), (3, "b", [0.9, 0.52], 0),
        (4, "b", [0.9, 0.54], 1), (5, "c", [0.0, 1.0], 1), (6, "d", [-1.0, 0.1], None),
    ]
    speakers = [("a", "male", "X"), ("b", "male", "Y"), ("c", "female", "X"), ("d", "female", "unknown")]
    categories = [
        ("gender", "male", [1.0, 0.2]), ("gender", "female", [-0.2, 1.0]),
        ("gender_nationality", "male:X", [1.0, 0.0]), ("gender_nationality", "male:Y", [0.9, 0.5]),
        ("gender_nationality", "female:X", [0.0, 1.0]),
    ]
    return Enrolled(
        spark.createDataFrame(gallery, GALLERY), spark.createDataFrame(speakers, SPEAKERS),
        spark.createDataFrame(categories, CATEGORIES),
        spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.3, 1.0])], CLUSTERS), width=2,
    )


@pytest.fixture
def probes(spark):
    return spark.createDataFrame([(10, "a", [1.0, 0.0]), (20, "c", [0.1, 0.995])], PROBES)


def swap(world, **changes):
    return Enrolled(**{**world.__dict__, **changes})


def ranked(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["speaker_id"])
    return out


def none_of(frame):
    return frame.where(F.lit(False))


def test_vote_and_closest(world, probes):
    assert ranked(search(probes, world, aggregation="closest", candidate_limit=4))[10] == ["a", "b"]
    assert ranked(search(probes, world, aggregation="vote", candidate_limit=4))[10] == ["b", "a"]
    top = search(probes, world, aggregation="closest", top_k=1).where("query_id = 10").first()
    assert (top["speaker_id"], top["score"]) == ("a", 1.0)
    far = search(probes, world, "euclidean", aggregation="closest", top_k=1).where("query_id = 10").first()
    assert (far["speaker_id"], far["score"]) == ("a", 0.0)


def test_metadata_route_limits_the_candidates(world, probes):
    for aggregation in ("closest", "vote", "speaker_centroid"):
        got = ranked(search(probes, world, architecture="metadata_hierarchy", aggregation=aggregation))
        assert got == {10: ["a"], 20: ["c"]}
        deep = ranked(search(probes, world, architecture="metadata_hierarchy", aggregation=aggregation, n_probes=9))
        assert set(deep[10]) == {"a", "b"} and deep[20] == ["c"]


def test_metadata_stored_with_the_gallery_saves_the_join(world, probes):
    wide = swap(world, gallery=world.gallery.join(world.speakers, "speaker_id"), speakers=None)
    found = search(probes, wide, architecture="metadata_hierarchy", aggregation="vote", n_probes=2)
    assert ranked(found) == ranked(
        search(probes, world, architecture="metadata_hierarchy", aggregation="vote", n_probes=2)
    )


def test_without_gender_centroids_there_is_no_restriction(world, probes):
    bare = swap(world, metadata_centroids=none_of(world.metadata_centroids))
    for aggregation in ("closest", "vote", "speaker_centroid"):
        assert ranked(search(probes, bare, architecture="metadata_hierarchy", aggregation=aggregation)) == ranked(
            search(probes, world, aggregation=aggregation)
        )


def test_gender_without_pairs_filters_by_gender_only(world, probes):
    only = swap(world, metadata_centroids=world.metadata_centroids.where("category = 'gender'"))
    for aggregation in ("closest", "speaker_centroid"):
        got = ranked(search(probes, only, architecture="metadata_hierarchy", aggregation=aggregation))
        assert got == {10: ["a", "b"], 20: ["c", "d"]}


def test_cluster_fallbacks(world, probes):
    got = ranked(search(probes, world, architecture="kmeans_clusters", aggregation="closest"))
    assert got == {10: ["a", "b"], 20: ["c", "b"]}
    bare = swap(world, cluster_centroids=none_of(world.cluster_centroids))
    assert ranked(search(probes, bare, architecture="kmeans_clusters", aggregation="closest")) == {}
    everyone = ranked(search(probes, world, aggregation="speaker_centroid"))
    assert ranked(search(probes, bare, architecture="kmeans_clusters", aggregation="speaker_centroid")) == everyone
    # A routed cluster without rows: no utterance hit, but centroids of all speakers.
    hollow = swap(world, gallery=world.gallery.where("cluster_id IS NULL OR cluster_id = 1"))
    assert set(ranked(search(probes, hollow, architecture="kmeans_clusters", aggregation="vote"))) == {20}
    wide = ranked(search(probes, hollow, architecture="kmeans_clusters", aggregation="speaker_centroid"))
    assert set(wide[10]) == {"b", "c", "d"} and set(wide[20]) == {"b", "c"}


def test_whole_speaker_is_ranked_once_for_all_its_clusters(world, probes):
    got = ranked(search(probes, world, architecture="kmeans_clusters", aggregation="speaker_centroid", n_probes=2))
    assert sorted(got[10]) == ["a", "b", "c"]


def test_unknown_settings_are_errors(world, probes):
    for change, message in (
        ({"architecture": "tree"}, "architecture"), ({"metric": "manhattan"}, "metric"),
        ({"aggregation": "median"}, "aggregation"),
    ):
        with pytest.raises(ValueError, match=message):
            search(probes, world, **change)
    with pytest.raises(ValueError, match="no way to rank"):
        rank_speakers(None, "median", "cosine", 1)


def test_ties_go_to_the_smaller_id_and_zero_vectors_come_last(spark):
    gallery = spark.createDataFrame(
        [(3, "c", [1.0, 0.0], 0), (2, "b", [2.0, 0.0], 0), (1, "z", [0.0, 0.0], 0), (4, "d", None, 0)], GALLERY
    )
    probes = spark.createDataFrame([(1, "b", [1.0, 0.0]), (2, "z", [0.0, 0.0])], PROBES)
    hits = utterance_hits(probes, Enrolled(gallery, width=2)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], r["distance"]) for r in hits] == [
        (1, 2, 0.0), (1, 3, 0.0), (1, 1, None), (2, 1, None), (2, 2, None), (2, 3, None),
    ]


@pytest.fixture(scope="module")
def crowd(spark):
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(1500, 8))
    rows[:500] = rows[0]  # a third of all rows are copies of one vector
    cluster = [0 if i < 500 else int(i % 5) for i in range(1500)]
    gallery = spark.createDataFrame(
        [(i, f"s{i % 60:02d}", rows[i].tolist(), cluster[i]) for i in range(1500)], GALLERY
    ).repartition(6)
    asked = [rows[0], *rng.normal(size=(40, 8))]
    probes = spark.createDataFrame([(i, f"s{i % 60:02d}", v.tolist()) for i, v in enumerate(asked)], PROBES)
    centroids = spark.createDataFrame([(c, rng.normal(size=8).tolist()) for c in range(5)], CLUSTERS)
    return rows, np.array(cluster), np.array(asked), Enrolled(gallery, cluster_centroids=centroids, width=8), probes


def by_query(frame):
    return [
        (r["query_id"], r["rank"], r["id"], round(r["distance"], 9))
        for r in frame.orderBy("query_id", "rank").collect()
    ]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_forms_agree_with_all_pairs(crowd, metric):
    rows, _, asked, enrolled, probes = crowd
    want = []
    for q, v in enumerate(asked):
        if metric == "cosine":
            d = 1 - rows @ v / np.linalg.norm(rows, axis=1) / np.linalg.norm(v)
        else:
            d = np.linalg.norm(rows - v, axis=1)
        order = np.lexsort((np.arange(len(rows)), np.round(d, 12)))[:25]
        want += [(q, n + 1, int(i), abs(round(d[i], 9))) for n, i in enumerate(order)]
    assert [(*r[:3], abs(r[3])) for r in by_query(utterance_hits(probes, enrolled, metric=metric))] == want
    near = nearest(probes.repartition(3), enrolled.gallery, 25, metric, strategy="candidates")
    assert [(*r[:3], abs(r[3])) for r in by_query(near)] == want
    assert "Exchange hashpartitioning(query_id" not in near._jdf.queryExecution().executedPlan().toString()
    grid = nearest(probes, enrolled.gallery, 25, metric, strategy="grid", width=8, cell_bytes=64 * 150)
    assert [(*r[:3], abs(r[3])) for r in by_query(grid)] == want


def test_routed_grid_equals_routed_stream(crowd):
    _, _, _, enrolled, probes = crowd
    for n in (1, 2):
        stream = utterance_hits(probes, enrolled, "kmeans_clusters", n_probes=n)
        grid = utterance_hits(probes, enrolled, "kmeans_clusters", n_probes=n, strategy="grid")
        assert by_query(stream) == by_query(grid)
    mixed = probes.withColumn("routed", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("0"), F.lit("3"))))
    common = {"routed": "routed", "bucket": "cluster_id"}
    stream = nearest(mixed, enrolled.gallery, 9, "cosine", **common)
    grid = nearest(mixed, enrolled.gallery, 9, "cosine", **common, strategy="grid", width=8, cell_bytes=64 * 9)
    assert by_query(stream) == by_query(grid)


def test_queries_beyond_the_bound_go_to_the_grid(crowd):
    _, _, _, enrolled, probes = crowd
    small = nearest(probes, enrolled.gallery, 5, "cosine", width=8, broadcast_bytes=1000)
    assert by_query(small) == by_query(nearest(probes, enrolled.gallery, 5, "cosine"))
    with pytest.raises(ValueError, match="broadcast bound"):
        nearest(probes, enrolled.gallery, 5, "cosine", strategy="queries", width=8, broadcast_bytes=1000)


def test_centroids_beyond_the_bound_give_the_same_lists(crowd):
    _, _, _, enrolled, probes = crowd
    centroids = enrolled.cluster_centroids.withColumnRenamed("centroid", "embedding")
    rows = probes.unionByName(probes.limit(1).selectExpr("99L AS query_id", "speaker_id", "CAST(NULL AS ARRAY<DOUBLE>) AS embedding"))

    def lists(**bound):
        found = append_nearest(rows, centroids, 3, "dot", "near", label="cluster_id", row_id="query_id", **bound)
        return sorted((r["query_id"], r["near"]) for r in found.collect())

    assert lists() == lists(broadcast_bytes=64, width=8)


def test_centroid_searches_agree_in_every_form(crowd):
    from nearkin.plans.search import centroid_hits

    _, _, _, enrolled, probes = crowd
    for architecture, n in (("brute_force", 1), ("kmeans_clusters", 1), ("kmeans_clusters", 3)):
        forms = [
            [(r["query_id"], r["rank"], r["speaker_id"], round(r["score"], 9)) for r in centroid_hits(
                probes, enrolled, architecture, n_probes=n, strategy=strategy
            ).orderBy("query_id", "rank").collect()]
            for strategy in ("candidates", "queries", "grid")
        ]
        assert forms[0] == forms[1] == forms[2] and len(forms[0]) == 41 * 10


def test_all_clusters_probed_equals_brute_force(crowd):
    _, _, _, enrolled, probes = crowd
    brute = utterance_hits(probes, enrolled)
    assert by_query(brute) == by_query(utterance_hits(probes, enrolled, "kmeans_clusters", n_probes=5))
    first = {r[0]: r[2] for r in by_query(brute) if r[1] == 1}
    top = search(probes, enrolled, aggregation="closest", top_k=1).collect()
    assert {r["query_id"]: r["speaker_id"] for r in top} == {q: f"s{i % 60:02d}" for q, i in first.items()}


def test_a_wrong_width_stops_the_search(crowd, spark):
    _, _, _, enrolled, _ = crowd
    probes = spark.createDataFrame([(1, "a", [1.0, 2.0])], PROBES)
    with pytest.raises(Exception, match="width"):
        utterance_hits(probes, enrolled).collect()


def test_sweep_settings(world, probes):
    assert depths([3, 0, 1, 3]) == [1, 3]
    assert aggregations("vote") == ["speaker_centroid", "vote"]
    with pytest.raises(ValueError):
        aggregations("median")
    row = evaluate(probes, world, aggregation="vote", candidate_limit=1).first()
    assert (row["top1_accuracy"], row["f1"], row["eer"]) == (100.0, 100.0, 0.0)
    got = sweep(probes, world, cluster_probes=(2, 1, 1), metadata_probes=(0,), utterance_mode="closest", top_k=2)
    rows = {(r["architecture"], r["aggregation"], r["cluster_probes"]): r for r in got.collect()}
    assert set(rows) == {
        (a, g, d) for a, ds in zip(ARCHITECTURES, ((1,), (1,), (1, 2))) for g in ("speaker_centroid", "closest") for d in ds
    }
    assert all(r["top1_accuracy"] == 100.0 and r["hit_k"] == 100.0 for r in rows.values())


def test_hit_rate_never_falls_with_k(crowd):
    from nearkin.operators.metrics import accuracy, outcomes

    _, _, _, enrolled, probes = crowd
    rates = [
        accuracy(outcomes(probes, search(probes, enrolled, top_k=k))).first()["hit_k"] for k in (1, 3, 10, 25)
    ]
    assert rates == sorted(rates)


def test_route_keeps_probes_in_place(world, probes):
    plan = route_metadata(probes, world.metadata_centroids, 2, "cosine")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_stacked_searches_equal_single_ones(world, probes):
    from nearkin.plans.search import centroid_hits, route, stacked_centroids, stacked_utterances

    no_pairs = swap(world, metadata_centroids=world.metadata_centroids.where("category = 'gender'"))
    no_genders = swap(world, metadata_centroids=none_of(world.metadata_centroids))
    for enrolled, metric in ((world, "cosine"), (no_pairs, "euclidean"), (no_genders, "cosine")):
        settings = [(a, d) for a in ARCHITECTURES for d in ((1, 2) if enrolled is world and a != "brute_force" else (1,))]
        asked = [(i, a, route(probes, enrolled, a, metric, d)) for i, (a, d) in enumerate(settings)]
        hits = stacked_utterances(asked, enrolled, metric, 4).collect()
        near = stacked_centroids(asked, enrolled, metric, 3).collect()
        for i, (a, d) in enumerate(settings):
            want = utterance_hits(probes, enrolled, a, metric, 4, d).collect()
            assert sorted((r.query_id, r["rank"], r.id) for r in hits if r.config == i) == sorted((r.query_id, r["rank"], r.id) for r in want)
            want = centroid_hits(probes, enrolled, a, metric, 3, d).collect()
            assert sorted((r.query_id, r["rank"], r.speaker_id) for r in near if r.config == i) == sorted((r.query_id, r["rank"], r.speaker_id) for r in want)


def test_a_sweep_reads_the_gallery_once_for_each_metric(crowd, spark):
    from nearkin.plans.search import route, stacked_utterances
    from nearkin.session import cut_lineage

    _, _, _, enrolled, probes = crowd
    stored = swap(enrolled, gallery=cut_lineage(enrolled.gallery))
    asked = [(i, "kmeans_clusters", route(probes, stored, "kmeans_clusters", "cosine", 3).withColumn("routed", F.slice("routed", 1, d))) for i, d in enumerate((1, 2, 3))]
    asked.append((3, "brute_force", probes))
    plan = stacked_utterances(asked, stored, "cosine", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


@pytest.mark.parametrize("cell_bytes", [64 * 1000, 64 * 60])
def test_a_task_holds_no_more_queries_than_its_results_allow(crowd, monkeypatch, cell_bytes):
    """Blocks of queries (one block of candidates would not do) and of candidates give the plain result."""
    _, _, asked, enrolled, probes = crowd
    routed = probes.withColumn("routed", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("0"), F.lit("3"))))
    common = {"routed": "routed", "bucket": "cluster_id", "width": 8}
    plain = by_query(nearest(routed, enrolled.gallery, 25, "cosine", **common))
    monkeypatch.setattr(nearest_module, "TASK_BYTES", 7 * (16 * 8 + 200 * 25), raising=False)
    held = []
    stream = nearest_module._stream_candidates

    def recorded(small, *rest):
        held.append(small.num_rows)
        return stream(small, *rest)

    monkeypatch.setattr(nearest_module, "_stream_candidates", recorded)
    assert by_query(nearest(routed, enrolled.gallery, 25, "cosine", cell_bytes=cell_bytes, **common)) == plain
    few = enrolled.gallery.where("id < 8")
    again = nearest(routed, few, 25, "cosine", cell_bytes=64 * 2, **common)
    assert by_query(again) == by_query(nearest(routed, few, 25, "cosine", strategy="candidates", **common))
    assert max(held, default=0) < len(asked)


def test_repeated_ids_count_alike_in_every_form(spark):
    rows = [(i // 2, "a", [1.0, float(i % 7)], 0) for i in range(40)]
    gallery = spark.createDataFrame(rows, GALLERY).repartition(4)
    probes = spark.createDataFrame([(i, "a", [1.0, float(i)]) for i in range(30)], PROBES)
    forms = [
        by_query(nearest(probes, gallery, 6, "euclidean", width=2, **form))
        for form in ({"strategy": "queries"}, {"strategy": "candidates"}, {"strategy": "grid", "cell_bytes": 16 * 8}, {"strategy": "grid"})
    ]
    assert forms[0] == forms[1] == forms[2] == forms[3]
    few = nearest(probes, gallery.where("id < 5"), 6, "euclidean", strategy="grid", width=2, cell_bytes=16 * 4)
    assert by_query(few) == by_query(nearest(probes, gallery.where("id < 5"), 6, "euclidean"))
    assert nearest(none_of(probes), gallery, 3, "cosine", strategy="grid").count() == 0
    assert nearest(probes, none_of(gallery), 3, "cosine", strategy="grid").count() == 0
