"""Vector means: centroids of speakers and categories, pooling of frames.

Means are partial aggregates: every task sends one vector per group, whatever
share of the rows a group holds.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.functions.text import known, pair_label
from nearkin.functions.vectors import as_double, l2_normalize


def _dense(vector: str | Column) -> Column:
    return array_to_vector(as_double(vector))


def vector_mean(
    frame: DataFrame, by: list[str], vector: str = "embedding", output: str = "embedding",
    *extra: Column,
) -> DataFrame:
    present = frame.where(F.col(vector).isNotNull())
    mean = vector_to_array(Summarizer.mean(_dense(vector))).alias(output)
    return present.groupBy(*by).agg(mean, *extra)


def speaker_sums(gallery: DataFrame) -> DataFrame:
    """``(speaker_id, total, n)``, the one pass over the vectors all centroids need."""
    summary = Summarizer.metrics("sum", "count").summary(_dense("embedding"))
    return (
        gallery.where(F.col("embedding").isNotNull())
        .groupBy("speaker_id")
        .agg(summary.alias("s"))
        .select("speaker_id", vector_to_array("s.sum").alias("total"), F.col("s.count").alias("n"))
    )


def speaker_centroids(gallery: DataFrame, *extra: Column) -> DataFrame:
    """Normalised mean of the raw vectors of each speaker."""
    means = vector_mean(gallery, ["speaker_id"], "embedding", "embedding", *extra)
    return means.withColumn("embedding", l2_normalize(F.col("embedding")))


def metadata_centroids(gallery: DataFrame, speakers: DataFrame) -> DataFrame:
    """``(category, category_value, centroid)`` for genders and gender:nationality pairs.

    Means are over utterances.  Vectors are summed per speaker before the
    metadata is joined, so no join sees the gallery itself.
    """
    gender, pair = F.col("gender"), pair_label(F.col("gender"), F.col("nationality"))
    layers = F.array(
        F.when(known(gender), F.struct(F.lit("gender").alias("c"), gender.alias("v"))),
        F.when(
            known(gender) & known(F.col("nationality")),
            F.struct(F.lit("gender_nationality").alias("c"), pair.alias("v")),
        ),
    )
    placed = speaker_sums(gallery).join(speakers, "speaker_id").select(
        "total", "n", F.explode(F.filter(layers, lambda layer: layer.isNotNull())).alias("layer")
    )
    sums = placed.groupBy(
        F.col("layer.c").alias("category"), F.col("layer.v").alias("category_value")
    ).agg(vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("t"), F.sum("n").alias("n"))
    return sums.select(
        "category", "category_value", _divide(F.col("t"), F.col("n")).alias("centroid")
    )


def masked_mean_pool(frames: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the valid frames per group; zeros where no frame is valid."""
    mask = F.col("valid").cast("double")
    masked = F.transform(as_double("embedding"), lambda x: x * mask)
    sums = frames.groupBy(*by).agg(
        vector_to_array(Summarizer.sum(array_to_vector(masked))).alias("t"),
        F.greatest(F.sum(mask), F.lit(1e-9)).alias("n"),
    )
    return sums.select(*by, _divide(F.col("t"), F.col("n")).alias("embedding"))


def layer_mean_pool(frames: DataFrame) -> DataFrame:
    """One vector per clip: the mean over its layer vectors, layer 0 left out."""
    layers = masked_mean_pool(frames.where(F.col("layer") > 0), ["clip_id", "layer"])
    return vector_mean(layers, ["clip_id"])


def _divide(vector: Column, by: Column) -> Column:
    return F.transform(vector, lambda x: x / by)
