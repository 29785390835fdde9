"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "nearkin", master: str | None = None, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    One is made up only where that setting is missing and all tasks run on this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="nearkin-shared-")
        context.setCheckpointDir(named)
    return named


class _Written(threading.local):
    """Paths of the tables this thread has written to the shared folder, oldest first."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_WRITTEN = _Written()


def written_tables() -> int:
    """How many tables this thread has written so far; marks a place for ``remove_tables``."""
    return len(_WRITTEN.paths)


def remove_tables(spark: SparkSession, first: int, last: int) -> None:
    """Delete the tables written from the place ``first`` up to before ``last``; nothing may read them any more."""
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for place, written in enumerate(_WRITTEN.paths[first:last], start=first):
        if written:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(settings).delete(path, True)
            _WRITTEN.paths[place] = ""


def cut_lineage(frame: DataFrame, by: str | None = None) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    They are written as a table, not as a checkpoint of rows, so later steps
    still read single columns and know the size of what they read.  ``by`` names a
    column whose values get folders of their own, so a filter on it reads only these.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/nearkin/{uuid.uuid4().hex}"
    _WRITTEN.paths.append(path)
    if by is None:
        frame.write.parquet(path)
    else:
        frame.hint("rebalance", by).write.partitionBy(by).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
