"""From ranked utterance hits to ranked speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearkin.functions.vectors import score_from_distance

MODES = ("closest", "vote")


def rank_speakers(
    hits: DataFrame, mode: str, metric: str, top_k: int, by: tuple[str, ...] = ()
) -> DataFrame:
    """``(query_id, rank, speaker_id, score, votes)`` from ``(query_id, rank, speaker_id, distance)``.

    ``closest`` orders speakers by their first hit.  ``vote`` orders them by the
    number of hits, then least distance, first position and id.  ``by`` names
    further columns that separate searches held in one frame.
    """
    if mode not in MODES:
        raise ValueError(f"no way to rank hits {mode!r}; choose from {', '.join(MODES)}")
    search = [*by, "query_id"]
    speakers = hits.groupBy(*search, "speaker_id").agg(
        F.count("*").alias("votes"), F.min("rank").alias("first"), F.min("distance").alias("least")
    )
    keys = [F.asc("first")]
    if mode == "vote":
        keys = [F.desc("votes"), F.asc_nulls_last("least"), *keys, F.asc("speaker_id")]
    order = Window.partitionBy(*search).orderBy(*keys)
    return (
        speakers.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
        .select(*search, "rank", "speaker_id",
                score_from_distance(metric, F.col("least")).alias("score"), "votes")
    )
