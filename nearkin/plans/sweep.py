"""Scoring of many search configurations in one go."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.functions.text import fixed_decimals
from nearkin.functions.vectors import METRICS
from nearkin.operators.metrics import METRIC_NAMES, outcomes, speaker_metrics
from nearkin.operators.ranking import MODES, rank_speakers
from nearkin.plans.search import (
    AGGREGATIONS,
    ARCHITECTURES,
    DEFAULT_CANDIDATE_LIMIT,
    DEFAULT_TOP_K,
    Enrolled,
    check_search,
    described_speakers,
    route,
    search,
    stacked_centroids,
    stacked_utterances,
)
from nearkin.session import cut_lineage


RANKED = ("query_id", "rank", "speaker_id", "score")


def depths(values: Sequence[int]) -> list[int]:
    return sorted({max(1, value) for value in values})


def aggregations(utterance_mode: str = "all") -> list[str]:
    """The centroid search always, the utterance modes as asked."""
    if utterance_mode not in ("all", *MODES):
        raise ValueError(f"no way to rank hits {utterance_mode!r}; choose all or one of {', '.join(MODES)}")
    return [a for a in AGGREGATIONS if a not in MODES or utterance_mode in ("all", a)]


def evaluate(
    probes: DataFrame,
    enrolled: Enrolled,
    metric: str = "cosine",
    architecture: str = "brute_force",
    aggregation: str = "closest",
    **settings,
) -> DataFrame:
    """The six metrics of one configuration, in one row."""
    ranked = search(probes, enrolled, metric, architecture, aggregation, **settings)
    return speaker_metrics(cut_lineage(outcomes(probes, ranked)))


def sweep(
    probes: DataFrame,
    enrolled: Enrolled,
    metrics: Sequence[str] = METRICS[:1],
    architectures: Sequence[str] = ARCHITECTURES,
    cluster_probes: Sequence[int] = (1,),
    metadata_probes: Sequence[int] = (1,),
    top_k: int = DEFAULT_TOP_K,
    candidate_limit: int = DEFAULT_CANDIDATE_LIMIT,
    utterance_mode: str = "all",
) -> DataFrame:
    """``(architecture, aggregation, metric, cluster_probes, six metrics)``.

    Speaker centroids are computed once.  Probes are routed once per metric and
    architecture, at the greatest depth; a smaller depth is the head of that
    route.  All configurations of a metric are then searched together: each asks on its own
    behalf with its own route, and the gallery is read once for all of them.  The hits
    are written once and read by both utterance modes, and all configurations are
    scored together, with the configuration as a grouping column.
    """
    spark = probes.sparkSession
    modes = aggregations(utterance_mode)
    wanted = {"kmeans_clusters": depths(cluster_probes), "metadata_hierarchy": depths(metadata_probes)}
    if enrolled.speaker_centroids is None:
        enrolled = replace(enrolled, speaker_centroids=cut_lineage(described_speakers(enrolled.gallery)))
    configs, ranked = [], []
    for metric in metrics:
        asked = []
        for architecture in architectures:
            check_search(architecture, AGGREGATIONS[0], metric)
            levels = wanted.get(architecture, [1])
            routed = route(probes, enrolled, architecture, metric, levels[-1])
            if architecture in wanted:
                routed = cut_lineage(routed)
            for depth in levels:
                at = routed
                if architecture in wanted:
                    at = routed.withColumn("routed", F.slice("routed", 1, depth))
                asked.append((len(configs), architecture, at))
                configs += [(len(configs) + i, architecture, m, metric, depth) for i, m in enumerate(modes)]
        ranked.append(stacked_centroids(asked, enrolled, metric, top_k).select(*RANKED, "config"))
        if len(modes) > 1:
            together = cut_lineage(stacked_utterances(asked, enrolled, metric, candidate_limit))
            for place, mode in enumerate(modes[1:], start=1):
                found = rank_speakers(together, mode, metric, top_k, ("config",))
                ranked.append(found.select(*RANKED, (F.col("config") + place).alias("config")))

    every = F.explode(F.sequence(F.lit(0), F.lit(len(configs) - 1)))
    asked = probes.select("query_id", "speaker_id", every.alias("config"))
    found = reduce(DataFrame.unionByName, ranked)
    rows = cut_lineage(outcomes(asked, found, ("config",)))
    names = spark.createDataFrame(
        configs, "config int, architecture string, aggregation string, metric string, cluster_probes int"
    )
    scores = names.join(speaker_metrics(rows, ("config",)), "config", "left")
    return scores.select(
        "architecture", "aggregation", "metric", "cluster_probes",
        *[F.coalesce(n, F.lit(0.0)).alias(n) for n in METRIC_NAMES],
    )


def results_table(results: DataFrame) -> DataFrame:
    """The metrics as text with two decimals."""
    keys = ["architecture", "aggregation", "metric", "cluster_probes"]
    return results.select(
        *keys, *[fixed_decimals(F.col(n)).alias(n) for n in METRIC_NAMES if n != "eer"]
    )


def report(results: DataFrame, summary: DataFrame, **run) -> DataFrame:
    """One row: the run's settings, the table counts, and the results by metric.

    Rows per metric are configurations, so the arrays stay small.
    """
    row = F.struct(
        "architecture", "aggregation", "metric", "cluster_probes",
        F.struct(*METRIC_NAMES).alias("metrics"),
    )
    lists = results.groupBy("metric").agg(F.collect_list(row).alias("rows")).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "rows"))).alias("results_by_metric")
    )
    facts = [F.lit(value).alias(name) for name, value in run.items()]
    counts = summary.agg(F.first(F.struct(*summary.columns))).scalar()
    return lists.select(
        F.current_timestamp().alias("timestamp"), *facts, counts.alias("database_summary"),
        "results_by_metric",
    )
