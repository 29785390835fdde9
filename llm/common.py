"""What several operators share: reading tables, shared tables, sizes, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.session import cut_lineage

__all__ = ["cut_lineage", "quiet_shuffles", "small_batches", "table", "input_bytes", "connected_components", "marked_places", "among", "signed", "text_digest", "free_name", "block_rows", "add_blocks"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quiet_shuffles(spark: SparkSession) -> None:
    """Let Spark remove a statement's shuffle files when its result has been written.

    The operators here go on from written tables, so nothing reads those files again.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand Arrow batches of about 4 MB to Python, whatever the length of the texts.

    A batch is held by the JVM, by the stream and by the Python worker; 10,000 rows of whole texts have no such bound.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def input_bytes(frame: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows."""
    return frame.select(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def text_digest(text: str = "text") -> Column:
    """SHA-256 of a text, which tells apart rows with one doc_id; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def free_name(columns: Iterable[str], name: str) -> str:
    """The name, with underscores before it until none of the columns has it in any spelling."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every end of an edge; the component is its smallest node.

    Alternates the large-star and the small-star step until only stars are left.
    Both only need the minimum of a node's neighbours, a partial aggregate, and a
    join of edges with those minima.  Minima are written before they are joined: both sides
    of the join are plain shuffles then, so adaptive execution can split a hot node.
    Each round is written to the shared folder; only one yes or no reaches the driver.
    Nulls, loops and repeated edges are ignored; no edge gives no row.
    """
    edges = cut_lineage(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col("u") != F.col("v")).distinct()
    )
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")))
        # No more rows than edges, so equal ones may stay until the minima are taken.
        large = cut_lineage(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        )
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(
            small.unionByName(least.withColumnRenamed("m", "v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where("u != v").distinct()
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _all_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v`` and no ``v`` is another edge's ``u``: each ``v`` then is its component's least node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").isEmpty()


PLACE_BITS = 24


def _place(columns: tuple[str, ...]) -> Column:
    return F.xxhash64(*columns).bitwiseAND((1 << PLACE_BITS) - 1)


def marked_places(wanted: DataFrame, *columns: str) -> DataFrame:
    """The places, among 2**24, of the values in these columns by a hash, 64 to a row: at most 2**18 rows, so they may be broadcast."""
    return cut_lineage(
        wanted.select(_place(columns).alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("marks"))
    )


def among(rows: DataFrame, marked: DataFrame, *columns: str, how: str = "left_semi") -> DataFrame:
    """The rows whose place is marked, or with ``left_anti`` the others, which surely hold none of the marked values.

    Rows are told apart where they lie, and the exact join that follows moves only those that may match.
    """
    place = _place(columns)
    hit = (F.shiftright(place, 6) == marked["word"]) & (F.getbit(marked["marks"], place.bitwiseAND(63).cast("int")) == 1)
    return rows.join(F.broadcast(marked), hit, how)


def block_rows(values: np.ndarray, size: int, **constant: int) -> pa.RecordBatch:
    """An array of counters as rows ``block, counts`` of ``size`` numbers each, blocks of zeros left out."""
    blocks = values.reshape(-1, size)
    used = np.flatnonzero(blocks.any(axis=1))
    arrays = [pa.array(used, pa.int64()), pa.array([blocks[i].tobytes() for i in used], pa.binary())]
    arrays += [pa.array(np.full(len(used), v), pa.int64()) for v in constant.values()]
    return pa.RecordBatch.from_arrays(arrays, ["block", "counts", *constant])


def add_blocks(frame: DataFrame, dtype: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of the ``counts`` arrays per key and block, in two levels, so no task gathers one from every task."""

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for raw in part.column("counts"):
                one = np.frombuffer(raw.as_buffer(), dtype=dtype)
                total = one.copy() if total is None else total + one
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k.as_py()], pa.int64()) for k in key), pa.array([total.tobytes()], pa.binary())],
            [*by, "counts"],
        )

    frame = frame.select("block", *keys, F.pmod(F.spark_partition_id(), F.lit(64)).alias("_slot"), "counts")
    for by in (["block", *keys, "_slot"], ["block", *keys]):
        schema = ", ".join(f"{k} long" for k in by) + ", counts binary"
        frame = frame.groupBy(*by).applyInArrow(add, schema)
    return frame
