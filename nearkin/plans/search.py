"""Searches: three architectures times three ways to aggregate hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.functions.text import pair_label
from nearkin.functions.vectors import check_metric
from nearkin.operators.means import speaker_centroids
from nearkin.operators.nearest import WIDEST_VECTOR, nearest
from nearkin.operators.ranking import MODES, rank_speakers
from nearkin.operators.routing import centroid_measure, route_clusters, route_metadata
from nearkin.session import cut_lineage

ARCHITECTURES = ("brute_force", "metadata_hierarchy", "kmeans_clusters")
AGGREGATIONS = ("speaker_centroid", *MODES)
DEFAULT_TOP_K = 10
DEFAULT_CANDIDATE_LIMIT = 25


@dataclass(frozen=True)
class Enrolled:
    """The tables of one model; brute force needs the gallery only."""

    gallery: DataFrame  # id, speaker_id, embedding, cluster_id
    speakers: DataFrame | None = None  # speaker_id, gender, nationality
    metadata_centroids: DataFrame | None = None  # category, category_value, centroid
    cluster_centroids: DataFrame | None = None  # cluster_id, centroid
    speaker_centroids: DataFrame | None = None  # stored result of described_speakers
    width: int = WIDEST_VECTOR


def check_search(architecture: str, aggregation: str, metric: str) -> None:
    check_metric(metric)
    if architecture not in ARCHITECTURES:
        raise ValueError(f"no architecture {architecture!r}; choose from {', '.join(ARCHITECTURES)}")
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"no aggregation {aggregation!r}; choose from {', '.join(AGGREGATIONS)}")


def route(
    probes: DataFrame, enrolled: Enrolled, architecture: str, metric: str, n_probes: int
) -> DataFrame:
    """Probes with ``routed``; brute force leaves them without that column."""
    if architecture == "metadata_hierarchy":
        return route_metadata(probes, enrolled.metadata_centroids, n_probes, metric)
    if architecture == "kmeans_clusters":
        return route_clusters(probes, enrolled.cluster_centroids, n_probes, metric)
    return probes


def _bucket_list():
    """A speaker can be reached by gender and by gender:nationality."""
    gender = F.lower("gender")
    return F.array(gender, pair_label(gender, F.col("nationality"))).alias("buckets")


def _speaker_buckets(speakers: DataFrame) -> DataFrame:
    return speakers.select("speaker_id", _bucket_list())


def described_speakers(gallery: DataFrame) -> DataFrame:
    """``(speaker_id, embedding, buckets)``: each centroid with the clusters of its clips.

    A whole speaker is ranked, and belongs to every cluster one of its clips is in.
    """
    gallery = gallery.where(F.col("speaker_id").isNotNull())
    if "cluster_id" not in gallery.columns:
        return speaker_centroids(gallery)
    return speaker_centroids(
        gallery, F.collect_set(F.col("cluster_id").cast("string")).alias("buckets")
    )


def utterance_hits(
    probes: DataFrame,
    enrolled: Enrolled,
    architecture: str = "brute_force",
    metric: str = "cosine",
    candidate_limit: int = DEFAULT_CANDIDATE_LIMIT,
    n_probes: int = 1,
    strategy: str = "auto",
) -> DataFrame:
    """``(query_id, rank, id, speaker_id, distance)``: the nearest gallery rows of each probe."""
    check_search(architecture, "closest", metric)
    routed = route(probes, enrolled, architecture, metric, n_probes)
    return routed_utterances(routed, enrolled, architecture, metric, candidate_limit, strategy)


def centroid_hits(
    probes: DataFrame,
    enrolled: Enrolled,
    architecture: str = "brute_force",
    metric: str = "cosine",
    top_k: int = DEFAULT_TOP_K,
    n_probes: int = 1,
    strategy: str = "auto",
) -> DataFrame:
    """``(query_id, rank, speaker_id, score)``: the nearest speaker centroids of each probe."""
    check_search(architecture, "speaker_centroid", metric)
    routed = route(probes, enrolled, architecture, metric, n_probes)
    return routed_centroids(routed, enrolled, architecture, metric, top_k, strategy)


def routed_utterances(
    routed: DataFrame, enrolled: Enrolled, architecture: str, metric: str, limit: int,
    strategy: str = "auto",
) -> DataFrame:
    """Utterance hits of probes that already carry their route."""
    gallery = enrolled.gallery.where(F.col("speaker_id").isNotNull())
    routing = {}
    if architecture == "metadata_hierarchy":
        if {"gender", "nationality"} <= set(gallery.columns):
            if "speaker_group" in gallery.columns and enrolled.speakers is not None:
                gallery = routed_groups(routed, gallery, enrolled.speakers)
            gallery = gallery.select("*", _bucket_list())  # stored with the rows: no join by speaker
        else:
            gallery = gallery.join(_speaker_buckets(enrolled.speakers), "speaker_id")
        routing = {"routed": "routed", "bucket": "buckets"}
    elif architecture == "kmeans_clusters":
        routing = {"routed": "routed", "bucket": "cluster_id"}
    return nearest(
        routed, gallery, limit, metric, key="id", labels=("speaker_id",),
        strategy=strategy, width=enrolled.width, **routing,
    )


def routed_groups(routed: DataFrame, gallery: DataFrame, speakers: DataFrame) -> DataFrame:
    """The gallery without the groups that no probe was routed to.

    A gallery laid out by group is then pruned while running: only folders that some probe wants are
    read.  The groups wanted are written first; there are as many as pairs of gender and nationality.
    """
    everything = F.array(F.lit("*"))
    asked = routed.select(F.explode(F.coalesce(F.col("routed").cast("array<string>"), everything)).alias("label")).distinct()
    gender = F.lower("gender")
    group = pair_label(gender, F.col("nationality"))
    offered = speakers.select(group.alias("speaker_group"), gender.alias("g")).distinct().select(
        "speaker_group", F.explode(F.array_distinct(F.array("speaker_group", "g", F.lit("*")))).alias("label")
    )
    wanted = cut_lineage(offered.join(asked, "label").select("speaker_group").distinct())
    # The filter keeps all groups; Spark prunes by a join only if the other side is filtered.
    return gallery.join(wanted.where("speaker_group > ''"), "speaker_group", "left_semi")


def routed_centroids(
    routed: DataFrame, enrolled: Enrolled, architecture: str, metric: str, top_k: int,
    strategy: str = "auto",
) -> DataFrame:
    """Centroid hits of probes that already carry their route.

    A probe whose buckets hold no speaker with a centroid searches all of them.
    """
    centroids = enrolled.speaker_centroids if enrolled.speaker_centroids is not None else cut_lineage(described_speakers(enrolled.gallery))
    routing = {}
    if architecture != "brute_force":
        if architecture == "metadata_hierarchy":
            buckets = _speaker_buckets(enrolled.speakers)
            centroids = centroids.drop("buckets").join(buckets, "speaker_id", "left")
        named = centroids.where(F.col("buckets").isNotNull()).select(F.explode("buckets").alias("b"))
        inhabited = named.agg(F.collect_set("b")).scalar()  # clusters or categories: few
        names = F.col("routed").cast("array<string>")
        routed = routed.withColumn("routed", F.when(F.arrays_overlap(names, inhabited), names))
        routing = {"routed": "routed", "bucket": "buckets"}
    hits = nearest(
        routed, centroids, top_k, centroid_measure(metric), key="speaker_id",
        strategy=strategy, few_candidates=True, width=enrolled.width, **routing,
    )
    # The product of unit vectors is the cosine score itself.
    return hits.select("query_id", "rank", "speaker_id", (-F.col("distance")).alias("score"))


#: How buckets of each architecture are named where searches of several are stacked; ``*`` is any row of it.
STACKED = {"metadata_hierarchy": "m:", "kmeans_clusters": "k:"}
Asked = list[tuple[int, str, DataFrame]]  # configuration, architecture, probes with their route


def _prefixed(names: Column, architecture: str) -> Column:
    return F.transform(names.cast("array<string>"), lambda name: F.concat(F.lit(STACKED[architecture]), name))


def _stack(asked: Asked, routes: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """All probes of all configurations; ``query_id`` is the pair of configuration and probe."""
    rows = []
    for config, architecture, probes in asked:
        routed = F.lit(None).cast("array<string>")
        if architecture in STACKED:
            routed = routes[architecture](F.col("routed").cast("array<string>"))
        rows.append(probes.select(F.struct(F.lit(config).alias("config"), "query_id").alias("query_id"), "embedding", routed.alias("routed")))
    return reduce(DataFrame.unionByName, rows)


def _unstack(hits: DataFrame, *columns: str | Column) -> DataFrame:
    return hits.select("query_id.config", F.col("query_id.query_id").alias("query_id"), "rank", *columns)


def stacked_utterances(asked: Asked, enrolled: Enrolled, metric: str, limit: int) -> DataFrame:
    """``(config, query_id, rank, id, speaker_id, distance)`` of several searches in one pass over the gallery."""
    gallery = enrolled.gallery.where(F.col("speaker_id").isNotNull())
    used, buckets = {architecture for _, architecture, _ in asked} & STACKED.keys(), []
    if "metadata_hierarchy" in used:
        if {"gender", "nationality"} <= set(gallery.columns):
            gallery = gallery.select("*", _bucket_list())
        else:
            gallery = gallery.join(_speaker_buckets(enrolled.speakers), "speaker_id", "left")
        own = F.concat(_prefixed(F.col("buckets"), "metadata_hierarchy"), F.array(F.lit("m:*")))
        buckets.append(F.coalesce(own, F.array().cast("array<string>")))
    if "kmeans_clusters" in used:
        own = _prefixed(F.array("cluster_id"), "kmeans_clusters")
        buckets.append(F.when(F.col("cluster_id").isNotNull(), own).otherwise(F.array().cast("array<string>")))
    routing = {}
    if used:
        gallery = gallery.withColumn("stacked", F.concat(*buckets))
        routing = {"routed": "routed", "bucket": "stacked"}
    routes = {
        # A probe without a metadata route searches all rows that have metadata.
        "metadata_hierarchy": lambda r: F.coalesce(_prefixed(r, "metadata_hierarchy"), F.array(F.lit("m:*"))),
        "kmeans_clusters": lambda r: _prefixed(r, "kmeans_clusters"),
    }
    hits = nearest(_stack(asked, routes), gallery, limit, metric, key="id", labels=("speaker_id",), width=enrolled.width, **routing)
    return _unstack(hits, "id", "speaker_id", "distance")


def stacked_centroids(asked: Asked, enrolled: Enrolled, metric: str, top_k: int) -> DataFrame:
    """``(config, query_id, rank, speaker_id, score)`` of several centroid searches in one pass over the centroids.

    As in a single search, a probe whose buckets hold no speaker with a centroid searches all of them.
    """
    centroids = enrolled.speaker_centroids if enrolled.speaker_centroids is not None else cut_lineage(described_speakers(enrolled.gallery))
    used, buckets, routes = {architecture for _, architecture, _ in asked} & STACKED.keys(), [], {}
    if "kmeans_clusters" in used:
        centroids = centroids.withColumn("_kmeans_clusters", F.col("buckets").cast("array<string>"))
    if "metadata_hierarchy" in used:
        own = _speaker_buckets(enrolled.speakers).withColumnRenamed("buckets", "_metadata_hierarchy")
        centroids = centroids.join(own, "speaker_id", "left")
    for architecture in sorted(used):
        names = F.col(f"_{architecture}")
        inhabited = centroids.where(names.isNotNull()).select(F.explode(names).alias("b")).agg(F.collect_set("b")).scalar()

        def routed(r: Column, architecture: str = architecture, inhabited: Column = inhabited) -> Column:
            return F.when(F.arrays_overlap(r, inhabited), _prefixed(r, architecture))

        routes[architecture] = routed
        buckets.append(F.coalesce(_prefixed(names, architecture), F.array().cast("array<string>")))
    routing = {}
    if used:
        centroids = centroids.withColumn("stacked", F.concat(*buckets))
        routing = {"routed": "routed", "bucket": "stacked"}
    hits = nearest(
        _stack(asked, routes), centroids, top_k, centroid_measure(metric), key="speaker_id", few_candidates=True, width=enrolled.width, **routing,
    )
    return _unstack(hits, "speaker_id", (-F.col("distance")).alias("score"))


def search(
    probes: DataFrame,
    enrolled: Enrolled,
    metric: str = "cosine",
    architecture: str = "brute_force",
    aggregation: str = "closest",
    top_k: int = DEFAULT_TOP_K,
    candidate_limit: int = DEFAULT_CANDIDATE_LIMIT,
    n_probes: int = 1,
    strategy: str = "auto",
) -> DataFrame:
    """``(query_id, rank, speaker_id, score)``: the ranked speakers of each probe."""
    check_search(architecture, aggregation, metric)
    if aggregation == "speaker_centroid":
        return centroid_hits(probes, enrolled, architecture, metric, top_k, n_probes, strategy)
    hits = utterance_hits(
        probes, enrolled, architecture, metric, candidate_limit, n_probes, strategy
    )
    return rank_speakers(hits, aggregation, metric, top_k).drop("votes")
