"""The four tables of one model, each model in its own database."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nearkin.models import Model
from nearkin.operators.order import number_rows
from nearkin.sources.readers import path_exists

# Table names and columns.
TABLES = {
    "speakers": "speaker_id STRING, gender STRING, nationality STRING",
    "audio_embeddings": (
        "id BIGINT, speaker_id STRING, file_path STRING, embedding ARRAY<FLOAT>, gender STRING, nationality STRING, "
        "speaker_group STRING, cluster_id INT"
    ),
    "metadata_centroids": "category STRING, category_value STRING, centroid ARRAY<DOUBLE>",
    "cluster_centroids": "cluster_id INT, centroid ARRAY<DOUBLE>",
}
# Kept beside them so that searches need not compute them again.
DERIVED = {
    "speaker_centroids": "speaker_id STRING, embedding ARRAY<DOUBLE>, buckets ARRAY<STRING>",
    "speaker_numbers": "speaker_id STRING, number BIGINT",
}
# Searches read whole clusters, or whole groups of one gender and nationality, so the gallery is laid
# out by both.  The first level is left out where its folders would hold few rows each.
PARTITIONED = {"audio_embeddings": ("speaker_group", "cluster_id")}
ROWS_PER_FOLDER = 1000

LIVE, BEFORE, MARK = "live_", "before_", "last_id"


def ensure_tables(spark: SparkSession, model: Model) -> None:
    """Create what is missing; existing tables stay as they are."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{model.namespace}`")
    known = properties(spark, model)
    missing = [t for t in (*TABLES, *DERIVED) if LIVE + t not in known]
    if missing:
        _set_properties(spark, model, {LIVE + t: _create(spark, model, t) for t in missing})


def _create(spark: SparkSession, model: Model, table: str, layout: tuple[str, ...] | None = None) -> str:
    """A new, empty version of a table and its name."""
    name, columns = f"{table}__{uuid.uuid4().hex[:12]}", (TABLES | DERIVED)[table]
    layout = PARTITIONED.get(table, ()) if layout is None else layout
    parts = f" PARTITIONED BY ({', '.join(layout)})" if layout else ""
    spark.sql(f"CREATE TABLE `{model.namespace}`.`{name}` ({columns}) USING parquet{parts}")
    return name


def properties(spark: SparkSession, model: Model) -> dict[str, str]:
    """What the catalogue says of the model: the live version of each table, and marks."""
    rows = spark.sql(f"DESCRIBE DATABASE EXTENDED `{model.namespace}`").where("info_name = 'Properties'").collect()
    return dict(re.findall(r"\((\w+),\s*(\w*)\)", rows[0]["info_value"])) if rows else {}


def _set_properties(spark: SparkSession, model: Model, values: dict[str, object]) -> None:
    """One statement to the catalogue, so that all values change together."""
    given = ", ".join(f"'{k}' = '{v}'" for k, v in values.items())
    spark.sql(f"ALTER DATABASE `{model.namespace}` SET DBPROPERTIES ({given})")


def set_mark(spark: SparkSession, model: Model, last_id: int) -> None:
    _set_properties(spark, model, {MARK: last_id})


def live_name(spark: SparkSession, model: Model, table: str) -> str:
    if table not in TABLES and table not in DERIVED:
        raise KeyError(f"no table {table!r}; there are {', '.join((*TABLES, *DERIVED))}")
    return f"`{model.namespace}`.`{properties(spark, model)[LIVE + table]}`"


def model_table(spark: SparkSession, model: Model, table: str) -> DataFrame:
    return spark.table(live_name(spark, model, table))


class Rebuild:
    """New versions of tables, which take the place of the live ones together, or not at all.

    ``write`` puts rows into a new table that no reader looks at.  ``commit`` names the new versions in
    the catalogue with one statement.  Leaving the block without it drops what was written.  The
    versions that were live stay until the next rebuild, for searches that are still reading them.
    """

    def __init__(self, spark: SparkSession, model: Model) -> None:
        self.spark, self.model = spark, model
        self.names: dict[str, str] = {}
        self.counts: dict[str, dict[str, int]] = {}
        ensure_tables(spark, model)

    def __enter__(self) -> Rebuild:
        return self

    def __exit__(self, *_: object) -> None:
        self._drop(self.names.values())
        self.names = {}

    def write(self, frame: DataFrame, table: str, layout: tuple[str, ...] | None = None, **counts: Column) -> DataFrame:
        """Write all rows of a table and read them back; ``counts`` are taken while the rows pass.

        Rows of one folder are brought together first, so that it is a few files; one too
        large for one task is split again while running.
        """
        name = _create(self.spark, self.model, table, layout)
        self.names[table] = name
        layout = PARTITIONED.get(table, ()) if layout is None else layout
        target = self.spark.table(f"`{self.model.namespace}`.`{name}`")
        given = set(frame.columns)
        rows = frame.select(*[
            (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields
        ])
        watched = Observation(name)
        if counts:
            rows = rows.observe(watched, *[c.alias(n) for n, c in counts.items()])
        if layout:
            rows = rows.hint("rebalance", *layout)
        rows.write.mode("append").insertInto(f"`{self.model.namespace}`.`{name}`")
        if counts:
            self.counts[table] = watched.get
        return self.spark.table(f"`{self.model.namespace}`.`{name}`")

    def commit(self, **marks: object) -> None:
        known = properties(self.spark, self.model)
        new = {LIVE + t: n for t, n in self.names.items()}
        old = {BEFORE + t: known[LIVE + t] for t in self.names}
        _set_properties(self.spark, self.model, {**new, **old, **marks})
        self._drop(known[BEFORE + t] for t in self.names if known.get(BEFORE + t))
        self.names = {}

    def _drop(self, names: Iterable[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{self.model.namespace}`.`{name}`")


def rebuild(frame: DataFrame, model: Model, table: str) -> None:
    """Replace all rows of a table."""
    with Rebuild(frame.sparkSession, model) as new:
        new.write(frame, table)
        new.commit()


def with_absent(existing: DataFrame, new: DataFrame, key: str = "speaker_id") -> DataFrame:
    """Existing rows unchanged, plus the new rows whose key was not there."""
    return existing.unionByName(absent(existing, new, key).select(*existing.columns))


def absent(existing: DataFrame, new: DataFrame, key: str = "speaker_id") -> DataFrame:
    """New rows whose key is not there, one for each key: the least by its other columns."""
    rest = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*") if rest else new.distinct()
    return once.select(*new.columns).join(existing.select(key), key, "left_anti")


def insert_absent(frame: DataFrame, model: Model, table: str = "speakers") -> None:
    existing = model_table(frame.sparkSession, model, table)
    absent(existing, frame).select(*existing.columns).write.mode("append").insertInto(
        live_name(frame.sparkSession, model, table)
    )


def assign_ids(clips: DataFrame, key: str = "file_path") -> DataFrame:
    """``(file_path, row_id)``: numbers from 1 in the order of the path."""
    return number_rows(clips.select(key), [F.asc(key)], "row_id").select(key, "row_id")


def number_new(numbered: DataFrame, clips: DataFrame, key: str = "file_path", mark: int | None = None) -> DataFrame:
    """``(file_path, row_id)`` of the clips not numbered yet, counted on from the largest number given so far.

    ``mark`` is that number where it is kept with the table; else it is read from ``numbered``.  Numbers
    given once stay, also those of rows that have been removed if the mark is kept.
    """
    if mark is None:
        mark = numbered.agg(F.max("row_id")).first()[0] or 0
    new = clips.select(key).distinct().join(numbered.select(key), key, "left_anti")
    return number_rows(new, [F.asc(key)], "row_id", after=mark).select(key, "row_id")


def append_finished(finished: DataFrame, path: str, batch: str | None = None) -> None:
    """Add a batch of finished clips to the store that resuming looks at.

    The rows are written first, under the batch and a name of this attempt, and a line of the commit log
    follows.  Rows without a line do not count, and of several attempts at a batch the first does.
    """
    spark, attempt = finished.sparkSession, uuid.uuid4().hex
    batch = batch or attempt
    finished.withColumns({"_batch": F.lit(batch), "_attempt": F.lit(attempt)}).write.mode("append").partitionBy(
        "_batch", "_attempt"
    ).parquet(f"{path}/rows")
    line = spark.range(1).select(F.lit(batch).alias("_batch"), F.lit(attempt).alias("_attempt"), F.current_timestamp().alias("at"))
    line.write.mode("append").parquet(f"{path}/log")


def finished_clips(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Clips finished so far; none when the store does not exist yet.

    Only folders of attempts that count are read.
    """
    if not path_exists(spark, f"{path}/log"):
        return spark.createDataFrame([], schema)
    log = spark.read.schema("_batch string, _attempt string, at timestamp").parquet(f"{path}/log")
    counted = log.groupBy("_batch").agg(F.min_by("_attempt", F.struct("at", "_attempt")).alias("_attempt"))
    stored = spark.read.schema(f"{schema}, _batch string, _attempt string").parquet(f"{path}/rows")
    return stored.join(counted, ["_batch", "_attempt"], "left_semi").drop("_batch", "_attempt")


def save_results(results: DataFrame, path: str, form: str = "json") -> None:
    """One row per configuration, in one folder per model when the rows name it."""
    writer = results.write.mode("overwrite").format(form)
    if "model" in results.columns:
        writer = writer.partitionBy("model")
    writer.save(path)
