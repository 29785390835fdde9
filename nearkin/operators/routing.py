"""Routing of probes to gallery buckets.

A route is an array column: null leaves the probe unrestricted, an empty array
leaves it without candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.functions.text import gender_of
from nearkin.functions.vectors import check_metric, l2_normalize
from nearkin.operators.nearest import append_nearest
from nearkin.operators.order import number_rows
from nearkin.session import cut_lineage

BLOCK_BITS = 32_768  # of one bitmap, which Spark's bitmap functions fix
GENDER, PAIR = "gender", "gender_nationality"


def centroid_measure(metric: str) -> str:
    """Centroids are normalised, so the cosine score is their plain product."""
    return "dot" if check_metric(metric) == "cosine" else metric


def category_centroids(centroids: DataFrame, category: str) -> DataFrame:
    """``(label, gender, embedding)`` of one category, normalised."""
    label = F.col("category_value")
    return centroids.where(F.col("category") == category).select(
        label.alias("label"), gender_of(label).alias("gender"),
        l2_normalize(F.col("centroid")).alias("embedding"),
    )


def route_gender(probes: DataFrame, centroids: DataFrame, metric: str) -> DataFrame:
    """Add ``best_gender``; null when there is no gender centroid."""
    found = append_nearest(
        probes, category_centroids(centroids, GENDER), 1, centroid_measure(metric), "_best",
        label="label", row_id="query_id",
    )
    return found.withColumn("best_gender", F.get("_best", F.lit(0))).drop("_best")


def route_metadata(probes: DataFrame, centroids: DataFrame, n: int, metric: str) -> DataFrame:
    """Add ``routed``: the best ``n`` pairs of the best gender.

    Without pairs under that gender the route is the gender itself; without any
    gender centroid there is no restriction.
    """
    pairs = append_nearest(
        route_gender(probes, centroids, metric), category_centroids(centroids, PAIR), n,
        centroid_measure(metric), "_pairs",
        label="label", row_id="query_id", within=("best_gender", "gender"),
    )
    routed = F.when(
        F.col("best_gender").isNotNull(),
        F.when(F.size("_pairs") > 0, F.col("_pairs")).otherwise(F.array("best_gender")),
    )
    return pairs.withColumn("routed", routed).drop("_pairs", "best_gender")


def route_clusters(probes: DataFrame, centroids: DataFrame, n: int, metric: str) -> DataFrame:
    """Add ``routed``: the ``n`` nearest clusters, none when there are no centroids."""
    known = centroids.select(
        "cluster_id", l2_normalize(F.col("centroid")).alias("embedding")
    )
    return append_nearest(
        probes, known, n, centroid_measure(metric), "routed", label="cluster_id", row_id="query_id"
    )


def route_table(routed: DataFrame) -> DataFrame:
    """``(query_id, rank, label)``, one row per routed bucket."""
    exploded = routed.select("query_id", F.posexplode("routed").alias("pos", "label"))
    return exploded.select("query_id", (F.col("pos") + 1).alias("rank"), "label")


def cluster_memberships(gallery: DataFrame) -> DataFrame:
    return gallery.where(F.col("cluster_id").isNotNull()).select("cluster_id", "speaker_id").distinct()


def number_speakers(speakers: DataFrame) -> DataFrame:
    """``(speaker_id, number)``: dense numbers from 1, in order of the id."""
    return number_rows(speakers.select("speaker_id").where(F.col("speaker_id").isNotNull()).distinct(), [F.asc("speaker_id")], "number")


def bucket_bitmaps(memberships: DataFrame, numbers: DataFrame, bucket: str) -> DataFrame:
    """``(label, block, bitmap)``: the speakers of each bucket, a bit for each of a block's 32,768 numbers.

    Bits are set in the map tasks, so a bucket's rows shrink to its bitmaps before they are shuffled.
    """
    named = memberships.withColumnRenamed(bucket, "label").join(numbers, "speaker_id")
    return named.groupBy("label", F.bitmap_bucket_number("number").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")
    )


def allowed_bitmaps(routes: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``(query_id, block, bitmap)``: the union of the buckets a probe was routed to."""
    return routes.join(bitmaps, "label").groupBy("query_id", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def _byte(bitmap: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bitmap, at + 1, F.lit(1))), 16, 10).cast("int")


def is_set(bitmap: Column, number: Column) -> Column:
    """Whether a number's bit is set in the bitmap of its block; the test of a single candidate."""
    at = F.bitmap_bit_position(number).cast("int")
    return F.call_function("shiftright", _byte(bitmap, F.floor(at / 8).cast("int")), at % 8) % 2 == 1


def set_numbers(bitmap: Column, block: Column) -> Column:
    """The numbers whose bits are set; bytes of zeros are passed over."""
    used = F.filter(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 8 - 1)), lambda i: F.substring(bitmap, i + 1, F.lit(1)) != F.lit(b"\0"))
    first = (block - 1) * BLOCK_BITS + 1
    bits = F.transform(used, lambda i: F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.when(F.call_function("shiftright", _byte(bitmap, i), j) % 2 == 1, first + i * 8 + j)),
        lambda number: number.isNotNull(),
    ))
    return F.flatten(bits)


def members_of(bitmaps: DataFrame, numbers: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, speaker_id)`` for every set bit.

    Bits are read in place and only those set become rows, which then take their speakers' names.
    """
    found = bitmaps.select(*keys, F.explode(set_numbers(F.col("bitmap"), F.col("block"))).alias("number"))
    return found.join(numbers, "number").select(*keys, "speaker_id")


def allowed_speakers(routes: DataFrame, memberships: DataFrame, bucket: str, numbers: DataFrame | None = None) -> DataFrame:
    """Distinct ``(query_id, speaker_id)`` over all buckets a probe was routed to, from bitmaps.

    ``numbers`` are the speakers' dense numbers where they are stored.
    """
    if numbers is None:
        numbers = cut_lineage(number_speakers(memberships))
    bitmaps = cut_lineage(bucket_bitmaps(memberships, numbers, bucket))
    return members_of(allowed_bitmaps(routes, bitmaps), numbers, "query_id")
