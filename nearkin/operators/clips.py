"""Clip tables: enrolment split, resuming, ordering and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.operators.order import number_rows
from nearkin.session import cut_lineage


def mark_holdout(clips: DataFrame, speaker: str = "speaker_id", video: str = "video_id") -> DataFrame:
    """Add ``held_out``: the clip is in the last video of a speaker who has several.

    A speaker has several videos when the first differs from the last, so two
    plain aggregates replace a distinct count.  They are written before the clips are joined to
    them, so that adaptive execution can split a speaker who holds many clips.
    """
    ends = cut_lineage(clips.groupBy(speaker).agg(F.min(video).alias("_first"), F.max(video).alias("_last")))
    last = (F.col(video) == F.col("_last")) & (F.col("_first") < F.col("_last"))
    return clips.join(ends, speaker).withColumn("held_out", last).drop("_first", "_last")


def split_holdout(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(gallery, probes)``: every clip is in exactly one of them."""
    marked = mark_holdout(clips)
    return (
        marked.where(~F.col("held_out")).drop("held_out"),
        marked.where("held_out").drop("held_out"),
    )


def pending_clips(clips: DataFrame, done: DataFrame) -> DataFrame:
    return clips.join(done.select("file_path"), "file_path", "left_anti")


def first_speakers(clips: DataFrame, n: int) -> DataFrame:
    """Clips of the first ``n`` speakers by id."""
    chosen = clips.select("speaker_id").distinct().orderBy("speaker_id").limit(n)
    return clips.join(chosen, "speaker_id", "left_semi")


def drop_failed(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(usable, quarantine)`` by the ``error`` column of the extraction step."""
    return clips.where(F.col("error").isNull()).drop("error"), clips.where(F.col("error").isNotNull())


def number_by_size(clips: DataFrame) -> DataFrame:
    """``(pos, file_path, size)``, largest clip first."""
    sized = clips.select("file_path", "size")
    return number_rows(sized, [F.desc("size"), F.asc("file_path")], "pos").select(
        "pos", "file_path", "size"
    )


def first_probes(probes: DataFrame, n: int | None) -> DataFrame:
    """The probes with the ``n`` smallest ids; only ids are sorted."""
    if n is None:
        return probes
    return probes.join(probes.select("query_id").orderBy("query_id").limit(n), "query_id", "left_semi")


def speaker_groups(speakers: DataFrame) -> DataFrame:
    """Members of each gender and gender:nationality group: ``(key, pos, speaker_id)``.

    The lists stay as rows, since one gender can hold half of all speakers.
    """
    gender = F.lower("gender")
    keys = F.array(gender, F.concat_ws(":", gender, "nationality"))
    members = speakers.select(F.explode(keys).alias("key"), "speaker_id")
    numbered = number_rows(members, [F.asc("key"), F.asc("speaker_id")], "_at")
    starts = numbered.groupBy("key").agg(F.min("_at").alias("_start"))
    return numbered.join(starts, "key").select(
        "key", (F.col("_at") - F.col("_start") + 1).alias("pos"), "speaker_id"
    )


def count_sets(**sets: DataFrame) -> DataFrame:
    """``(part, utterances, speakers)`` per named clip table, speakers counted exactly."""
    rows = None
    for part, clips in sets.items():
        counted = (
            clips.groupBy("speaker_id").agg(F.count("*").alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("utterances"),
                 F.count("speaker_id").alias("speakers"))
            .select(F.lit(part).alias("part"), "utterances", "speakers")
        )
        rows = counted if rows is None else rows.unionByName(counted)
    return rows
