"""Counts, profiles and input checks over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.models import Model
from nearkin.plans.search import Enrolled
from nearkin.sources.tables import LIVE, TABLES, properties


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, rows)``, one row per table, also for empty ones."""
    return _stack(
        [frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
         for name, frame in tables.items()]
    )


def database_summary(enrolled: Enrolled) -> DataFrame:
    """The row counts of the four tables in one row."""
    tables = {
        "speakers": enrolled.speakers,
        "audio_embeddings": enrolled.gallery,
        "metadata_centroids": enrolled.metadata_centroids,
        "cluster_centroids": enrolled.cluster_centroids,
    }
    counts = table_counts(tables)
    return counts.agg(
        *[F.max(F.when(F.col("table") == name, F.col("rows"))).alias(name) for name in tables]
    )


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, column, type, nullable, rows)`` for every column of every table."""
    spark = next(iter(tables.values())).sparkSession
    columns = [
        (name, field.name, field.dataType.simpleString(), field.nullable)
        for name, frame in tables.items()
        for field in frame.schema.fields
    ]
    described = spark.createDataFrame(
        columns, "table string, column string, type string, nullable boolean"
    )
    return described.join(table_counts(tables), "table")


def database_tables(spark: SparkSession, namespace: str) -> dict[str, DataFrame]:
    """The tables of a database by name; of a model's tables the live versions."""
    found = [t.name for t in spark.catalog.listTables(namespace) if not t.isTemporary]
    model = Model(namespace, 0, namespace)
    live = {name.removeprefix(LIVE): value for name, value in properties(spark, model).items() if name.startswith(LIVE)}
    if live:
        return {name: spark.table(f"`{namespace}`.`{live[name]}`") for name in TABLES if live.get(name) in found}
    return {name: spark.table(f"`{namespace}`.`{name}`") for name in found}


# The columns each stage needs of its inputs.
STAGES = {
    "populate": {
        "gallery": ("speaker_id", "file_path", "embedding"),
        "metadata": ("speaker_id", "gender", "nationality"),
    },
    "evaluate": {"probes": ("query_id", "speaker_id", "embedding")},
}


def contract_check(
    frame: DataFrame, dim: int, required: tuple[str, ...] = STAGES["populate"]["gallery"],
    label: str = "speaker_id",
) -> DataFrame:
    """``(check_name, violations)``: columns, rows, labels and vector widths, in one pass."""
    missing = [c for c in required if c not in frame.columns]

    def broken(column: str, condition):
        return F.count(F.when(condition, 1)) if column in frame.columns else F.count("*")

    counted = frame.agg(
        F.lit(len(missing)).cast("long").alias("missing_columns"),
        F.when(F.count("*") == 0, 1).otherwise(0).cast("long").alias("no_rows"),
        broken(label, F.col(label).isNull() if label in frame.columns else None).alias("missing_label"),
        broken("embedding", F.col("embedding").isNull() if "embedding" in frame.columns else None)
        .alias("missing_vector"),
        broken("embedding", F.size("embedding") != dim if "embedding" in frame.columns else None)
        .alias("wrong_width"),
    )
    return counted.unpivot([], counted.columns, "check_name", "violations")


def stage_check(stage: str, inputs: dict[str, DataFrame], dim: int) -> DataFrame:
    """``(input, check_name, violations)`` over the inputs one stage needs."""
    if stage not in STAGES:
        raise ValueError(f"Unknown stage: {stage}")
    checks = []
    for name, required in STAGES[stage].items():
        if name not in inputs:
            raise ValueError(f"stage {stage} needs the input {name}")
        found = contract_check(inputs[name], dim, required)
        if "embedding" not in required:
            found = found.where(~F.col("check_name").isin("missing_vector", "wrong_width"))
        checks.append(found.select(F.lit(name).alias("input"), "check_name", "violations"))
    return _stack(checks)
