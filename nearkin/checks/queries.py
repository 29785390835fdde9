"""Registered queries: one per operator, over whole tables.

Vectors leave as rows ``(pos, value)`` and measured values with six decimals, so
results compare by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.checks.fixtures import CLUSTERS, WIDTH, Views
from nearkin.functions.text import fixed_decimals, is_clip, speaker_of, video_of
from nearkin.functions.vectors import (
    cosine_distance,
    dot,
    euclidean_distance,
    format_vector,
    l2_normalize,
    parse_vector,
    round6,
    score_from_distance,
)
from nearkin.operators import clips as clip_ops
from nearkin.operators.clusters import (
    as_clustering,
    assign_clusters,
    full_batch,
    mini_batches,
    train_clusters,
    update_clusters,
)
from nearkin.operators.means import (
    layer_mean_pool,
    masked_mean_pool,
    speaker_centroids,
    vector_mean,
)
from nearkin.operators.metrics import (
    accuracy,
    class_counts,
    equal_error_rate,
    macro_scores,
    outcomes,
    speaker_metrics,
)
from nearkin.operators.ranking import rank_speakers
from nearkin.operators.routing import (
    allowed_speakers,
    cluster_memberships,
    route_clusters,
    route_gender,
    route_metadata,
    route_table,
)
from nearkin.plans import profile
from nearkin.plans.search import search, utterance_hits
from nearkin.plans.sweep import results_table, sweep
from nearkin.session import cut_lineage, shared_folder
from nearkin.sources import readers
from nearkin.sources.tables import append_finished, assign_ids, finished_clips, number_new, with_absent

TOP_K = 3
LIMIT = 25
N_PROBES = 2
FIRST_PROBES = 20
FIRST_SPEAKERS = 5
EXPECTED_DIM = 32
FILTER_NATIONS = ["NATION_0", "NATION_2"]
FILTER_CLUSTERS = [0, 3]
FULL_STEPS = 2  # of k-means from the fixed seeds
BATCH_ROWS, BATCHES = 64, 4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _register(name: str) -> Callable:
    def register(build: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        return build

    return register


def _elements(frame: DataFrame, vector: str, *keys: str | Column) -> DataFrame:
    exploded = frame.select(*keys, F.posexplode(vector).alias("p", "v"))
    names = [c for c in exploded.columns if c not in ("p", "v")]
    return exploded.select(*names, (F.col("p") + 1).alias("pos"), round6(F.col("v")).alias("value"))


# Sources


@_register("gallery_scan")
def _gallery_scan(v: Views) -> DataFrame:
    stored = v.gallery().select(
        F.col("speaker_id").alias("speakers"), F.col("file_path").alias("processed_files"),
        F.col("embedding").alias("embeddings"),
    )
    scanned = readers.describe_vectors(readers.require_dim(readers.as_gallery(stored), WIDTH))
    return scanned.withColumn("norm", round6(F.col("norm")))


@_register("probe_scan")
def _probe_scan(v: Views) -> DataFrame:
    stored = v.split()[1].select(
        F.col("id").alias("query_id"), F.col("speaker_id").alias("speakers"),
        F.col("file_path").alias("file_paths"), F.col("embedding").alias("x"),
    )
    scanned = readers.describe_vectors(readers.as_probes(stored))
    return scanned.withColumn("norm", round6(F.col("norm")))


@_register("speaker_metadata")
def _speaker_metadata(v: Views) -> DataFrame:
    return readers.clean_metadata(v.metadata_raw())


@_register("speakers_with_default")
def _speakers_with_default(v: Views) -> DataFrame:
    return v.speakers()


@_register("speakers_insert_absent")
def _speakers_insert_absent(v: Views) -> DataFrame:
    return with_absent(v.speakers_old(), v.speakers())


@_register("assign_ids")
def _assign_ids(v: Views) -> DataFrame:
    return assign_ids(v.clips())


@_register("assign_ids_append")
def _assign_ids_append(v: Views) -> DataFrame:
    """Numbers of a first delivery, and of a second that holds it again."""
    first = cut_lineage(assign_ids(v.done()))
    return first.unionByName(number_new(first, v.clips()))


@_register("path_parse")
def _path_parse(v: Views) -> DataFrame:
    path = F.col("file_path")
    return v.clips().select(
        path, speaker_of(path).alias("speaker_id"), video_of(path).alias("video_id"),
        is_clip(path).alias("is_wav"),
    )


@_register("resume_pending")
def _resume_pending(v: Views) -> DataFrame:
    """Clips missing from a store that holds one batch twice and one that was never committed."""
    clips, schema = v.clips().select("file_path", "speaker_id"), "file_path string, u int"
    store = f"{shared_folder(v.spark)}/nearkin/{uuid.uuid4().hex}"
    done = v.clips().where("id % 3 = 0").select("file_path", "u")
    for batch in (0, 1, 0):
        append_finished(done.where(F.col("u") % 2 == batch), store, f"batch{batch}")
    v.clips().where("id % 3 = 1").select("file_path", "u", F.lit("late").alias("_batch"), F.lit("lost").alias("_attempt")).write.mode(
        "append").partitionBy("_batch", "_attempt").parquet(f"{store}/rows")
    finished = finished_clips(v.spark, store, schema).groupBy("file_path").agg(F.count("*").alias("times"))
    once = finished.where("times = 1")
    return clip_ops.pending_clips(clips, once)


@_register("clips_by_size")
def _clips_by_size(v: Views) -> DataFrame:
    size = (F.length("file_path") * 1000 + F.col("u")).alias("size")
    return clip_ops.number_by_size(v.clips().select("file_path", size))


@_register("first_n_speakers")
def _first_n_speakers(v: Views) -> DataFrame:
    return clip_ops.first_speakers(v.clips().select("id", "speaker_id"), FIRST_SPEAKERS)


@_register("catalog_counts")
def _catalog_counts(v: Views) -> DataFrame:
    return clip_ops.count_sets(gallery=v.gallery(), probes=v.probes())


@_register("holdout_split")
def _holdout_split(v: Views) -> DataFrame:
    gallery, probes = v.split()
    return gallery.select("id", F.lit("gallery").alias("part")).unionByName(
        probes.select("id", F.lit("probe").alias("part"))
    )


@_register("limit_probes")
def _limit_probes(v: Views) -> DataFrame:
    return clip_ops.first_probes(v.probes().select("query_id", "speaker_id"), FIRST_PROBES)


@_register("dim_violations")
def _dim_violations(v: Views) -> DataFrame:
    return readers.dim_violations(v.clips(), EXPECTED_DIM)


def _listed_files(v: Views) -> DataFrame:
    """Every clip, and a note beside each fourth."""
    note = F.when(F.col("id") % 4 == 0, F.regexp_replace("file_path", r"wav$", "txt"))
    paths = F.explode(F.filter(F.array("file_path", note), lambda x: x.isNotNull()))
    return v.clips().select(paths.alias("file_path"), (F.col("id") * 100 + 44).alias("size"))


@_register("clip_catalog")
def _clip_catalog(v: Views) -> DataFrame:
    """The clips among the listed files."""
    return readers.catalog_rows(_listed_files(v))


@_register("clip_catalog_speakers")
def _clip_catalog_speakers(v: Views) -> DataFrame:
    """Clips and bytes of each speaker in the catalogue."""
    return readers.catalog_rows(_listed_files(v)).groupBy("speaker_id").agg(F.count("*").alias("clips"), F.sum("size").alias("bytes"))


# Vector functions: every gallery row against the mean of its own speaker


def _with_own_mean(v: Views) -> DataFrame:
    means = vector_mean(v.gallery(), ["speaker_id"], "embedding", "mean")
    return v.gallery().join(means, "speaker_id")


@_register("distance_cosine")
def _distance_cosine(v: Views) -> DataFrame:
    d = cosine_distance(F.col("embedding"), F.col("mean"))
    return _with_own_mean(v).select("id", "speaker_id", round6(d).alias("distance"))


@_register("distance_euclidean")
def _distance_euclidean(v: Views) -> DataFrame:
    d = euclidean_distance(F.col("embedding"), F.col("mean"))
    return _with_own_mean(v).select("id", "speaker_id", round6(d).alias("distance"))


@_register("dot_product")
def _dot_product(v: Views) -> DataFrame:
    value = dot(F.col("embedding"), F.col("mean"))
    return _with_own_mean(v).select("id", "speaker_id", round6(value).alias("value"))


@_register("score_from_distance")
def _score_from_distance(v: Views) -> DataFrame:
    pair = F.col("embedding"), F.col("mean")
    return _with_own_mean(v).select(
        "id",
        round6(score_from_distance("cosine", cosine_distance(*pair))).alias("score_cosine"),
        round6(score_from_distance("euclidean", euclidean_distance(*pair))).alias("score_euclidean"),
    )


@_register("l2_normalize")
def _l2_normalize(v: Views) -> DataFrame:
    unit = v.clips().select("id", l2_normalize(F.col("embedding")).alias("unit"))
    return _elements(unit, "unit", "id")


@_register("fixed_decimals")
def _fixed_decimals(v: Views) -> DataFrame:
    value = (F.col("id") * 10 + 5) / F.lit(1000.0)  # 0.175 and 2.675 among them, most of them no exact ties
    return v.clips().select("id", fixed_decimals(value).alias("two"), fixed_decimals(-value, 1).alias("one"))


@_register("vector_text_roundtrip")
def _vector_text_roundtrip(v: Views) -> DataFrame:
    text = v.clips().select("id", format_vector(F.col("embedding")).alias("t"))
    parts = F.split(F.regexp_replace("t", r"[\[\]]", ""), ",")
    both = F.arrays_zip(parse_vector(F.col("t")).alias("value"), parts.alias("text"))
    back = text.select("id", F.posexplode(both).alias("p", "e"))
    return back.select(
        "id", (F.col("p") + 1).alias("pos"), round6(F.col("e.value")).alias("value"), "e.text"
    )


@_register("masked_mean_pool")
def _masked_mean_pool(v: Views) -> DataFrame:
    return _elements(masked_mean_pool(v.frames(), ["clip_id", "layer"]), "embedding", "clip_id", "layer")


@_register("layer_mean_pool")
def _layer_mean_pool(v: Views) -> DataFrame:
    return _elements(layer_mean_pool(v.frames()), "embedding", "clip_id")


# Joins and filters


def _located(v: Views) -> DataFrame:
    rows = v.gallery().select("id", "speaker_id")
    return rows.join(v.speakers(), "speaker_id").select("id", "speaker_id", "gender", "nationality")


@_register("gallery_with_speakers")
def _gallery_with_speakers(v: Views) -> DataFrame:
    return _located(v)


@_register("filter_gender")
def _filter_gender(v: Views) -> DataFrame:
    return _located(v).where(readers.gallery_filter(gender="female")).select("id", "speaker_id")


@_register("filter_gender_nat")
def _filter_gender_nat(v: Views) -> DataFrame:
    condition = readers.gallery_filter(gender="male", nationalities=FILTER_NATIONS)
    return _located(v).where(condition).select("id", "speaker_id")


@_register("filter_cluster")
def _filter_cluster(v: Views) -> DataFrame:
    condition = readers.gallery_filter(clusters=FILTER_CLUSTERS)
    return v.gallery_clustered().where(condition).select("id", "speaker_id")


# Centroids and clusters


@_register("vector_mean")
def _vector_mean(v: Views) -> DataFrame:
    return _elements(vector_mean(v.gallery(), ["speaker_id"]), "embedding", "speaker_id")


@_register("speaker_centroids")
def _speaker_centroids(v: Views) -> DataFrame:
    return _elements(speaker_centroids(v.gallery()), "embedding", "speaker_id")


@_register("metadata_centroids")
def _metadata_centroids(v: Views) -> DataFrame:
    return _elements(v.metadata_centroids(), "centroid", "category", "category_value")


@_register("metadata_groups")
def _metadata_groups(v: Views) -> DataFrame:
    return clip_ops.speaker_groups(v.speakers())


@_register("cluster_memberships")
def _cluster_memberships(v: Views) -> DataFrame:
    return cluster_memberships(v.gallery_clustered())


@_register("kmeans_step")
def _kmeans_step(v: Views) -> DataFrame:
    return _elements(v.clusters(), "centroid", "cluster_id")


@_register("cluster_assign")
def _cluster_assign(v: Views) -> DataFrame:
    assigned = assign_clusters(v.gallery(), v.clusters()).select("id", "cluster_id")
    return update_clusters(v.gallery().select("id"), assigned)


def _seed_centres(v: Views) -> np.ndarray:
    return np.array([r["centroid"] for r in v.seeds().orderBy("cluster_id").collect()])


@_register("kmeans_full_batch")
def _kmeans_full_batch(v: Views) -> DataFrame:
    centres = full_batch(cut_lineage(v.gallery()), _seed_centres(v), iterations=FULL_STEPS, tolerance=0.0)
    return _elements(as_clustering(v.spark, centres, WIDTH).trained, "centroid", "cluster_id")


@_register("kmeans_mini_batch")
def _kmeans_mini_batch(v: Views) -> DataFrame:
    centres = mini_batches(v.gallery(), _seed_centres(v), BATCH_ROWS, most_batches=BATCHES, starved=0.0)
    return _elements(as_clustering(v.spark, centres, WIDTH).trained, "centroid", "cluster_id")


@_register("kmeans_labels")
def _kmeans_labels(v: Views) -> DataFrame:
    gallery = cut_lineage(v.gallery())
    centres = full_batch(gallery, _seed_centres(v), iterations=FULL_STEPS, tolerance=0.0)
    return as_clustering(v.spark, centres, WIDTH).label(gallery).select("id", "cluster_id")


@_register("kmeans_train")
def _kmeans_train(v: Views) -> DataFrame:
    gallery = cut_lineage(v.gallery())  # every step reads it again
    return train_clusters(gallery, CLUSTERS, width=WIDTH).label(gallery).groupBy("cluster_id").agg(F.count("*").alias("n"))


# Routing


@_register("route_gender")
def _route_gender(v: Views) -> DataFrame:
    routed = route_gender(v.probes(), cut_lineage(v.metadata_centroids()), "cosine")
    return routed.select("query_id", F.lit(1).alias("rank"), F.col("best_gender").alias("label"))


def _metadata_routes(v: Views) -> DataFrame:
    centroids = cut_lineage(v.metadata_centroids())
    return route_table(route_metadata(v.probes(), centroids, N_PROBES, "cosine"))


def _cluster_routes(v: Views, clusters: DataFrame) -> DataFrame:
    return route_table(route_clusters(v.probes(), clusters, N_PROBES, "cosine"))


@_register("route_metadata")
def _route_metadata(v: Views) -> DataFrame:
    return _metadata_routes(v)


@_register("route_cluster")
def _route_cluster(v: Views) -> DataFrame:
    return _cluster_routes(v, v.clusters())


@_register("allowed_speakers")
def _allowed_speakers(v: Views) -> DataFrame:
    clusters = cut_lineage(v.clusters())
    members = cluster_memberships(v.gallery_clustered(clusters))
    return allowed_speakers(_cluster_routes(v, clusters), members, "cluster_id")


@_register("allowed_speakers_metadata")
def _allowed_speakers_metadata(v: Views) -> DataFrame:
    pair = F.concat_ws(":", "gender", "nationality").alias("pair")
    return allowed_speakers(_metadata_routes(v), v.speakers().select(pair, "speaker_id"), "pair")


# Searches


def _hits(v: Views, architecture: str, metric: str = "cosine", strategy: str = "auto") -> DataFrame:
    return utterance_hits(
        v.probes(), v.enrolled(architecture), architecture, metric, LIMIT, N_PROBES, strategy
    )


def _search(v: Views, architecture: str, aggregation: str) -> DataFrame:
    return search(
        v.probes(), v.enrolled(architecture), "cosine", architecture, aggregation, TOP_K, LIMIT, N_PROBES
    )


def _rounded(frame: DataFrame, column: str) -> DataFrame:
    return frame.withColumn(column, round6(F.col(column)))


def _register_searches() -> None:
    def knn(architecture, metric="cosine", strategy="auto"):
        return lambda spark, folder: _rounded(
            _hits(Views(spark, folder), architecture, metric, strategy), "distance"
        )

    def ranked(mode):
        return lambda spark, folder: _rounded(
            rank_speakers(_hits(Views(spark, folder), "brute_force"), mode, "cosine", TOP_K), "score"
        )

    def found(architecture, aggregation):
        return lambda spark, folder: _rounded(
            _search(Views(spark, folder), architecture, aggregation), "score"
        )

    short = {"brute": "brute_force", "metadata": "metadata_hierarchy", "kmeans": "kmeans_clusters"}
    QUERIES["knn_brute_cosine"] = knn("brute_force")
    QUERIES["knn_brute_euclidean"] = knn("brute_force", "euclidean")
    QUERIES["knn_brute_grid"] = knn("brute_force", strategy="grid")
    QUERIES["knn_metadata"] = knn("metadata_hierarchy")
    QUERIES["knn_kmeans"] = knn("kmeans_clusters")
    QUERIES["knn_kmeans_grid"] = knn("kmeans_clusters", strategy="grid")
    for mode in ("closest", "vote"):
        QUERIES[f"rank_{mode}"] = ranked(mode)
    for name, aggregation in (("centroid", "speaker_centroid"), ("closest", "closest"), ("vote", "vote")):
        for suffix, architecture in short.items():
            QUERIES[f"{name}_{suffix}"] = found(architecture, aggregation)


_register_searches()


# Fallbacks: what a search does where a route leads nowhere


@_register("fallback_no_gender")
def _fallback_no_gender(v: Views) -> DataFrame:
    """Without centroids of genders a search by metadata covers all rows."""
    enrolled = v.enrolled("metadata_hierarchy")
    pairs = replace(enrolled, metadata_centroids=enrolled.metadata_centroids.where("category <> 'gender'"))
    return _rounded(utterance_hits(v.probes(), pairs, "metadata_hierarchy", "cosine", LIMIT, N_PROBES), "distance")


@_register("fallback_gender_only")
def _fallback_gender_only(v: Views) -> DataFrame:
    """Without centroids of men's nationalities probes like men are searched among all men."""
    enrolled = v.enrolled("metadata_hierarchy")
    known = enrolled.metadata_centroids.where("category_value not like 'male:%'")
    hits = utterance_hits(v.probes(), replace(enrolled, metadata_centroids=known), "metadata_hierarchy", "cosine", LIMIT, N_PROBES)
    return _rounded(hits, "distance")


@_register("fallback_no_clusters")
def _fallback_no_clusters(v: Views) -> DataFrame:
    """Without cluster centroids a centroid search covers all speakers."""
    enrolled = v.enrolled("kmeans_clusters")
    none = replace(enrolled, cluster_centroids=enrolled.cluster_centroids.where("cluster_id < 0"))
    return _rounded(search(v.probes(), none, "cosine", "kmeans_clusters", "speaker_centroid", TOP_K), "score")


@_register("fallback_empty_clusters")
def _fallback_empty_clusters(v: Views) -> DataFrame:
    """A probe whose cluster holds no speaker is compared with all of them."""
    enrolled = v.enrolled("kmeans_clusters")
    left = F.when(~F.col("cluster_id").isin(FILTER_CLUSTERS), F.col("cluster_id"))
    emptied = replace(enrolled, gallery=cut_lineage(enrolled.gallery.withColumn("cluster_id", left)))
    return _rounded(search(v.probes(), emptied, "cosine", "kmeans_clusters", "speaker_centroid", TOP_K), "score")


@_register("fallback_no_hits")
def _fallback_no_hits(v: Views) -> DataFrame:
    """Probes without hits count as wrong, with a score of their own."""
    enrolled = v.enrolled("kmeans_clusters")
    none = replace(enrolled, cluster_centroids=enrolled.cluster_centroids.where("cluster_id < 0"))
    found = search(v.probes(), none, "cosine", "kmeans_clusters", "closest", TOP_K)
    return outcomes(v.probes(), found).groupBy("truth", "prediction", "score", "correct").agg(F.count("*").alias("probes"))


# Scoring


def _outcomes(v: Views, architecture: str = "kmeans_clusters") -> DataFrame:
    return cut_lineage(outcomes(v.probes(), _search(v, architecture, "closest")))


def _percentages(frame: DataFrame) -> DataFrame:
    doubles = [name for name, kind in frame.dtypes if kind == "double"]
    return frame.withColumns({name: round6(F.col(name)) for name in doubles})


@_register("top1_accuracy")
def _top1_accuracy(v: Views) -> DataFrame:
    return _percentages(accuracy(_outcomes(v)).select("top1_accuracy"))


@_register("hit_at_k")
def _hit_at_k(v: Views) -> DataFrame:
    return _percentages(accuracy(_outcomes(v)).select("hit_k"))


@_register("macro_prf")
def _macro_prf(v: Views) -> DataFrame:
    return _percentages(macro_scores(class_counts(_outcomes(v))))


@_register("per_class_counts")
def _per_class_counts(v: Views) -> DataFrame:
    return class_counts(_outcomes(v))


@_register("eer")
def _eer(v: Views) -> DataFrame:
    return _percentages(equal_error_rate(_outcomes(v, "brute_force")))


@_register("speaker_metrics")
def _speaker_metrics(v: Views) -> DataFrame:
    return _percentages(speaker_metrics(_outcomes(v)))


def _sweep(v: Views) -> DataFrame:
    return sweep(
        cut_lineage(v.probes()), v.enrolled("all"), ("cosine", "euclidean"), cluster_probes=(N_PROBES,),
        metadata_probes=(N_PROBES,), top_k=TOP_K, candidate_limit=LIMIT,
    )


@_register("sweep_results")
def _sweep_results(v: Views) -> DataFrame:
    return _percentages(_sweep(v))


@_register("results_table")
def _results_table(v: Views) -> DataFrame:
    return results_table(_sweep(v))


# Profiles


@_register("database_summary")
def _database_summary(v: Views) -> DataFrame:
    return profile.database_summary(v.enrolled("all"))


@_register("contract_check")
def _contract_check(v: Views) -> DataFrame:
    return profile.contract_check(v.clips(), WIDTH)


@_register("stage_check")
def _stage_check(v: Views) -> DataFrame:
    """What the inputs of an enrolment lack."""
    metadata = readers.clean_metadata(v.metadata_raw())
    return profile.stage_check("populate", {"gallery": v.clips(), "metadata": metadata}, EXPECTED_DIM)


@_register("table_profile")
def _table_profile(v: Views) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
             "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    return profile.table_profile({n: v.spark.read.parquet(f"{v.folder}/{n}.parquet") for n in names})
