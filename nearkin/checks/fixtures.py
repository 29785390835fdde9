"""Test views derived from the ``embeddings`` and ``nation`` tables.

Identities come from ``vec_id`` by arithmetic: 40 speakers, most with four
videos, vectors of differing length, and metadata that is dirty on purpose.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.functions.text import UNKNOWN, video_of
from nearkin.functions.vectors import l2_normalize
from nearkin.operators.clips import split_holdout
from nearkin.operators.clusters import assign_clusters, lloyd_step
from nearkin.operators.means import metadata_centroids
from nearkin.plans.search import Enrolled
from nearkin.session import cut_lineage
from nearkin.sources.readers import clean_metadata, speakers_with_default

WIDTH = 64
SPEAKERS = 40
CLUSTERS = 8


def _once(build):
    name = f"_{build.__name__}"

    @wraps(build)
    def stored(self):
        if name not in self.__dict__:
            self.__dict__[name] = build(self)
        return self.__dict__[name]

    return stored


# The two tables in use; a given schema saves a look into the files.
SCHEMAS = {
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}


class Views:
    """Lazy frames over the tables of one folder; each is built once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    @_once
    def clips(self) -> DataFrame:
        parts = self.table("embeddings").selectExpr(
            "vec_id",
            "embedding",
            f"CAST(vec_id % {SPEAKERS} AS INT) AS sp",
            f"CAST(floor(vec_id / {SPEAKERS}) AS INT) AS u",
        ).selectExpr(
            "*",
            "CASE WHEN sp % 10 = 9 THEN 0 ELSE u % 4 END AS vid",
            "concat('id', CAST(10000 + sp AS STRING)) AS speaker_id",
        )
        return parts.selectExpr(
            "vec_id AS id",
            "speaker_id",
            "concat('/wav/', speaker_id, '/vid', CAST(vid AS STRING), '/',"
            " lpad(CAST(u AS STRING), 5, '0'), '.wav') AS file_path",
            "sp", "vid", "u",
            "transform(CAST(embedding AS ARRAY<DOUBLE>), x -> x * (1 + vec_id % 3)) AS embedding",
        )

    @_once
    def split(self) -> tuple[DataFrame, DataFrame]:
        return split_holdout(self.clips().withColumn("video_id", video_of(F.col("file_path"))))

    @_once
    def gallery(self) -> DataFrame:
        return self.split()[0].select("id", "speaker_id", "file_path", "embedding")

    @_once
    def probes(self) -> DataFrame:
        return self.split()[1].select(
            F.col("id").alias("query_id"), "speaker_id",
            l2_normalize(F.col("embedding")).alias("embedding"),
        )

    def metadata_raw(self) -> DataFrame:
        speakers = self.clips().select("sp").where("sp <> 38").distinct()
        nation = self.table("nation").select("n_nationkey", "n_name")
        sp = F.col("sp")
        return speakers.join(nation, F.col("n_nationkey") == sp % 5, "left").select(
            F.concat(F.lit(" id"), (10000 + sp).cast("string")).alias("id_raw"),
            F.when(sp % 8 == 7, "x").when(sp % 2 == 0, " M ").otherwise("f").alias("gender_raw"),
            F.when(sp % 13 != 12, F.col("n_name")).alias("nationality_raw"),
        )

    @_once
    def speakers(self) -> DataFrame:
        return speakers_with_default(self.clips(), clean_metadata(self.metadata_raw()))

    def speakers_old(self) -> DataFrame:
        first = self.clips().where("sp < 10").select("speaker_id").distinct()
        return first.select(
            "speaker_id", F.lit(UNKNOWN).alias("gender"), F.lit(UNKNOWN).alias("nationality")
        )

    def seeds(self) -> DataFrame:
        first = self.gallery().orderBy("id").limit(CLUSTERS)
        ids = first.agg(F.sort_array(F.collect_list("id"))).scalar()
        return self.gallery().where(F.array_contains(ids, F.col("id"))).select(
            (F.array_position(ids, F.col("id")) - 1).cast("int").alias("cluster_id"),
            l2_normalize(F.col("embedding")).alias("centroid"),
        )

    @_once
    def clusters(self) -> DataFrame:
        return lloyd_step(self.gallery(), self.seeds())

    def gallery_clustered(self, clusters: DataFrame | None = None) -> DataFrame:
        return assign_clusters(self.gallery(), clusters or self.clusters())

    def frames(self) -> DataFrame:
        return self.clips().select(
            F.col("sp").alias("clip_id"), (F.col("u") % 3).alias("layer"), F.col("u").alias("frame"),
            (F.col("id") % 7 != 0).alias("valid"), "embedding",
        )

    def done(self) -> DataFrame:
        return self.clips().where(F.col("id") % 3 == 0).select("file_path")

    @_once
    def metadata_centroids(self) -> DataFrame:
        return metadata_centroids(self.gallery(), self.speakers())

    def enrolled(self, architecture: str = "brute_force") -> Enrolled:
        """The tables one architecture searches; what enrolment would store is written out."""
        if architecture == "brute_force":
            return Enrolled(self.gallery(), width=WIDTH)
        if architecture == "metadata_hierarchy":
            centroids = cut_lineage(self.metadata_centroids())
            return Enrolled(self.gallery(), self.speakers(), centroids, width=WIDTH)
        clusters = cut_lineage(self.clusters())
        if architecture == "kmeans_clusters":
            return Enrolled(self.gallery_clustered(clusters), cluster_centroids=clusters, width=WIDTH)
        stored = (self.gallery_clustered(clusters), self.speakers(), self.metadata_centroids())
        return Enrolled(*map(cut_lineage, stored), clusters, width=WIDTH)
