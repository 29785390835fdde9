"""Enrolment: from clips with vectors to the tables of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.functions.text import pair_label
from nearkin.models import Model
from nearkin.operators.clusters import assign_clusters, train_clusters
from nearkin.operators.means import metadata_centroids
from nearkin.operators.order import number_rows
from nearkin.operators.routing import number_speakers
from nearkin.plans.search import Enrolled, described_speakers
from nearkin.session import cut_lineage
from nearkin.sources.readers import require_dim, speakers_with_default
from nearkin.sources.tables import (
    MARK,
    PARTITIONED,
    ROWS_PER_FOLDER,
    Rebuild,
    ensure_tables,
    insert_absent,
    live_name,
    model_table,
    properties,
    set_mark,
)


def enroll(
    model: Model, clips: DataFrame, metadata: DataFrame, clusters: int = 256, seed: int = 42,
    training: str = "mini_batch", layout: tuple[str, ...] | None = None,
) -> Enrolled:
    """Build all tables of ``model`` anew; they replace the old ones together when all are written.

    ``clips`` hold ``speaker_id, file_path, embedding`` with unique paths.  Clips without a label or
    vector are counted while the gallery is written and stop the enrolment before that, as any
    failing stage does.  ``layout`` names the columns that get folders in the gallery.
    """
    spark = clips.sparkSession
    with Rebuild(spark, model) as new:
        checked = require_dim(clips, model.dim).select("speaker_id", "file_path", "embedding")
        # Numbering writes the rows out in path order; all later stages read that table.
        gallery = number_rows(checked, [F.asc("file_path")], "id")
        speakers = new.write(speakers_with_default(gallery, metadata), "speakers")
        new.write(number_speakers(speakers), "speaker_numbers")
        new.write(metadata_centroids(gallery, speakers), "metadata_centroids")
        trained = train_clusters(gallery, clusters, seed, width=model.dim, method=training)
        new.write(trained.centroids, "cluster_centroids")
        stored = new.write(
            with_groups(trained.label(gallery), speakers), "audio_embeddings",
            layout=gallery_layout(gallery, speakers, clusters) if layout is None else layout,
            last=F.max("id"), missing_label=F.count_if(F.col("speaker_id").isNull()), missing_vector=F.count_if(F.col("embedding").isNull()),
        )
        new.write(described_speakers(stored), "speaker_centroids")
        counts = new.counts["audio_embeddings"]
        bad = {name: n for name, n in counts.items() if name != "last" and n}
        if bad:
            raise ValueError(f"clips that cannot be enrolled: {bad}")
        new.commit(last_id=counts["last"] or 0)
    return open_model(spark, model)


def with_groups(gallery: DataFrame, speakers: DataFrame) -> DataFrame:
    """The gallery with what a search routes by: gender, nationality and both as one label."""
    label = pair_label(F.lower("gender"), F.col("nationality"))
    return gallery.join(speakers, "speaker_id", "left").withColumn("speaker_group", label)


def gallery_layout(gallery: DataFrame, speakers: DataFrame, clusters: int) -> tuple[str, ...]:
    """Folders by group and cluster if they hold enough rows on average, else by cluster alone."""
    groups = speakers.select("gender", "nationality").distinct().count()
    enough = gallery.count() >= ROWS_PER_FOLDER * groups * clusters
    return PARTITIONED["audio_embeddings"] if enough else PARTITIONED["audio_embeddings"][1:]


def append_clips(model: Model, clips: DataFrame, metadata: DataFrame) -> int:
    """Add the clips whose paths are not enrolled yet; the number of rows added.

    Their ids go on after the largest ever given, their clusters are those of the nearest stored
    centroid, and their speakers are added if absent.  Centroids stay as they are until the next enrolment.
    """
    spark = clips.sparkSession
    ensure_tables(spark, model)
    stored = model_table(spark, model, "audio_embeddings")
    new = require_dim(clips, model.dim).select("speaker_id", "file_path", "embedding").join(
        stored.select("file_path"), "file_path", "left_anti"
    )
    # An append that broke off before its mark was set has left larger ids in the table.
    mark = max(int(properties(spark, model).get(MARK) or 0), stored.agg(F.max("id")).first()[0] or 0)
    numbered = cut_lineage(number_rows(new, [F.asc("file_path")], "id", after=mark))
    insert_absent(speakers_with_default(numbered, metadata), model)
    placed = assign_clusters(numbered, model_table(spark, model, "cluster_centroids"), width=model.dim)
    rows = with_groups(placed, model_table(spark, model, "speakers"))
    added, last = numbered.agg(F.count("*"), F.max("id")).first()
    if added:
        target = live_name(spark, model, "audio_embeddings")
        fields = spark.table(target).schema.fields
        rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.mode("append").insertInto(target)
        set_mark(spark, model, last)
    return added


def open_model(spark: SparkSession, model: Model) -> Enrolled:
    """The stored tables of a model, ready to be searched."""
    centroids = model_table(spark, model, "speaker_centroids")
    return Enrolled(
        gallery=model_table(spark, model, "audio_embeddings"),
        speakers=model_table(spark, model, "speakers"),
        metadata_centroids=model_table(spark, model, "metadata_centroids"),
        cluster_centroids=model_table(spark, model, "cluster_centroids"),
        speaker_centroids=centroids,
        width=model.dim,
    )
