"""Nearest rows: exact top-k of candidates for every query.

Both sides are DataFrames; three physical forms give the same rows.

``queries``
    The query side is small: it is broadcast and candidates stream past it
    where they lie.  Only the running top-k of each task is shuffled, so the
    gallery never moves.
``candidates``
    The candidate side is small (centroids): it is broadcast and the queries
    stream past it.  Nothing is shuffled and nothing is left to merge.
``grid``
    Both sides are large: the one that makes fewer rows pass is laid out in blocks that fit a
    broadcast, and the other streams past each block where it lies.  Only running top-k lists
    are shuffled.

A side is broadcast only after a bounded read has shown that it fits.  A task that holds queries
also holds the running top-k of each, so fewer of these fit than candidates do: ``task_rows``.

Routing restricts a query to candidates of some buckets.  ``routed`` is an array
column of the queries: null means no restriction, an empty array means no
candidate at all.  ``buckets`` is an array column of the candidates, since a
speaker can belong to several clusters.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearkin.operators import topk
from nearkin.operators.topk import TopK, route_index, row_slices, to_matrix
from nearkin.session import cut_lineage

# Ship the kernel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(topk)

BROADCAST_BYTES = 32 << 20
WIDEST_VECTOR = 1024
# Bytes of one block of a side.  How often the other one is read falls with this size.
CELL_BYTES = 32 << 20
# Bytes a task may hold of queries that rows stream past: their vectors twice and their results.
TASK_BYTES = 32 << 20
# A search leaves at most this many partial lists per query, however many files it reads.
MERGED_LISTS = 20_000
# Above this many buckets a filter on them is no longer written into the scan.
PUSHED_BUCKETS = 1000


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    measure: str,
    *,
    key: str = "id",
    labels: tuple[str, ...] = (),
    routed: str | None = None,
    bucket: str | None = None,
    strategy: str = "auto",
    few_candidates: bool = False,
    width: int = WIDEST_VECTOR,
    broadcast_bytes: int = BROADCAST_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """Rows ``(query_id, rank, key, *labels, distance)``, at most ``k`` per query.

    Queries carry ``query_id`` and ``embedding``; candidates carry ``key``,
    ``labels`` and ``embedding``.  Null vectors are no candidates.  ``bucket``
    names a scalar or an array column of the candidates.  ``few_candidates``
    makes the automatic choice try the candidate side first.
    """
    if measure not in topk.MEASURES:
        raise ValueError(f"Unsupported measure: {measure}")
    if strategy not in ("auto", "queries", "candidates", "grid"):
        raise ValueError(f"Unsupported strategy: {strategy}")
    k = max(1, k)
    left = queries.where(F.col("embedding").isNotNull()).select(
        "query_id",
        F.col("embedding").alias("_vector"),
        (F.col(routed).cast("array<string>") if routed else _no_list()).alias("_routed"),
    )
    candidates = candidates.where(F.col("embedding").isNotNull())
    schema = T.StructType(
        [T.StructField("query_id", left.schema["query_id"].dataType)]
        + [T.StructField(name, candidates.schema[name].dataType) for name in (key, *labels)]
        + [T.StructField("distance", T.DoubleType())]
    )
    if strategy == "candidates" or (strategy == "auto" and few_candidates):
        right = _candidate_side(candidates, key, labels, bucket)
        small = read_bounded(right, broadcast_bytes, width)
        if small is not None:
            return _stream_queries(small, left, k, measure, schema)
    if strategy in ("auto", "queries"):
        small = read_bounded(left, min(broadcast_bytes, 8 * width * task_rows(k, width)), width)
        if small is not None:
            restriction = _pushed_buckets(small.column("_routed"), candidates, bucket)
            right = _candidate_side(candidates.where(restriction), key, labels, bucket)
            return keep_nearest(_stream_candidates(small, right, k, measure, schema), k, key)
    if strategy in ("queries", "candidates"):
        raise ValueError(f"the {strategy} are larger than the broadcast bound")
    block_rows = max(1, cell_bytes // (8 * width))
    most = min(block_rows, task_rows(k, width)), block_rows
    return keep_nearest(_blocks(left, candidates, k, measure, schema, most, bucket), k, key)


def task_rows(k: int, width: int) -> int:
    """How many queries a task holds at once while rows stream past them."""
    return max(1, TASK_BYTES // (16 * width + topk.HIT_BYTES * k))


def keep_nearest(hits: DataFrame, k: int, key: str) -> DataFrame:
    """Merge partial top-k lists; Spark cuts them on both sides of the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), F.asc(key))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kept = [c for c in hits.columns if c not in ("query_id", "distance")]
    return ranked.select("query_id", "rank", *kept, "distance")


def append_nearest(
    rows: DataFrame,
    centroids: DataFrame,
    k: int,
    measure: str,
    output: str,
    *,
    label: str,
    row_id: str,
    vector: str = "embedding",
    within: tuple[str, str] | None = None,
    width: int = WIDEST_VECTOR,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add an array column with the ``k`` nearest centroid labels, nearest first.

    ``within = (row column, centroid column)`` compares a row only with the
    centroids of its own group.  Rows with a null vector get null, rows without
    any centroid an empty array.  Rows stay where they are: nothing is shuffled
    unless the centroids are too many to broadcast.
    """
    k = max(1, k)
    known = centroids.where(F.col("embedding").isNotNull()).select(
        F.col(label).alias("label"),
        F.col("embedding").alias("_vector"),
        (F.array(F.col(within[1]).cast("string")) if within else _no_list()).alias("_buckets"),
    )
    group = F.array(F.col(within[0]).cast("string")) if within else _no_list()
    small = read_bounded(known, broadcast_bytes, width)
    if small is None:
        hits = nearest(
            rows.select(F.col(row_id).alias("query_id"), F.col(vector).alias("embedding"),
                        group.alias("_group")),
            known.withColumnRenamed("_vector", "embedding"),
            k, measure, key="label", routed="_group", bucket="_buckets", strategy="grid",
        )
        ordered = F.sort_array(F.collect_list(F.struct("rank", "label")))  # at most k entries
        lists = hits.groupBy(F.col("query_id").alias(row_id)).agg(
            F.transform(ordered, lambda hit: hit["label"]).alias(output)
        )
        found = F.when(F.col(vector).isNotNull(), F.coalesce(output, F.array()))
        return rows.join(lists, row_id, "left").withColumn(output, found)

    shared = rows.sparkSession.sparkContext.broadcast(small)
    label_type = centroids.schema[label].dataType
    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.ArrayType(label_type))])
    task = _append_task(shared, k, measure, vector, output)
    return rows.withColumn("_routed", group).mapInArrow(task, schema)


def read_bounded(frame: DataFrame, max_bytes: int, width: int = WIDEST_VECTOR) -> pa.Table | None:
    """All rows if they fit into ``max_bytes``, else None; reads no more than that."""
    max_rows = max(1, max_bytes // (8 * width))
    table = frame.limit(max_rows + 1).toArrow()
    return None if table.num_rows > max_rows or table.nbytes > max_bytes else table.combine_chunks()


def _no_list() -> Column:
    return F.lit(None).cast("array<string>")


def _is_array(frame: DataFrame, column: str) -> bool:
    return isinstance(frame.schema[column].dataType, T.ArrayType)


def _candidate_side(candidates, key, labels, bucket) -> DataFrame:
    if bucket is None:
        buckets = _no_list()
    elif _is_array(candidates, bucket):
        buckets = F.col(bucket).cast("array<string>")
    else:
        buckets = F.array(F.col(bucket).cast("string"))
    return candidates.select(
        key, *labels, F.col("embedding").alias("_vector"), buckets.alias("_buckets")
    )


def _pushed_buckets(routed: pa.ChunkedArray, candidates: DataFrame, bucket: str | None) -> Column:
    """A filter for the scan: only buckets some query was routed to."""
    free, by_bucket = route_index(routed)
    if bucket is None or len(free) or len(by_bucket) > PUSHED_BUCKETS:
        return F.lit(True)
    if not by_bucket:
        return F.lit(False)
    names = sorted(by_bucket)
    if _is_array(candidates, bucket):
        # one literal, split while planning: much quicker to build than an array of literals
        wanted = F.split(F.lit("\x00".join(names)), "\x00")
        return F.arrays_overlap(F.col(bucket).cast("array<string>"), wanted)
    if isinstance(candidates.schema[bucket].dataType, T.IntegralType):
        numbers = [name for name in names if name.lstrip("-").isdigit()]
        return F.expr(f"`{bucket}` IN ({', '.join(numbers)})") if numbers else F.lit(False)
    return F.col(bucket).cast("string").isin(names)


def _stream_candidates(small, right, k, measure, schema) -> DataFrame:
    shared = right.sparkSession.sparkContext.broadcast(small)

    def run(batches):
        queries = shared.value
        best = TopK(to_matrix(queries.column("_vector")), k, measure)
        routes = route_index(queries.column("_routed"))
        for batch in batches:
            best.feed_routed(pa.Table.from_batches([batch]), routes)
        yield from best.hits(queries.column("query_id"))

    return right.coalesce(MERGED_LISTS).mapInArrow(run, schema)


def _stream_queries(small, left, k, measure, schema) -> DataFrame:
    shared = left.sparkSession.sparkContext.broadcast(small)
    names = [f.name for f in schema.fields]
    ranked = T.StructType([schema.fields[0], T.StructField("rank", T.IntegerType()), *schema.fields[1:]])

    def run(batches):
        buckets = route_index(shared.value.column("_buckets"))
        for queries in row_slices(batches):
            best = TopK(to_matrix(queries.column("_vector")), k, measure)
            best.feed_routed(shared.value, route_index(queries.column("_routed")), buckets)
            for hits in best.hits(queries.column("query_id")):
                rank = best.ranks().astype(np.int32)
                yield hits.add_column(1, "rank", pa.array(rank)).select(
                    [names[0], "rank", *names[1:]]
                )

    return left.mapInArrow(run, ranked)


def _append_task(shared, k, measure, vector, output) -> Callable:
    def run(batches):
        known = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            present = table.column(vector).is_valid()
            queries = table.select([vector, "_routed"]).filter(present)
            best = TopK(to_matrix(queries.column(vector)), k, measure)
            best.feed_routed(known, route_index(queries.column("_routed")))
            lists = best.label_lists("label", known.schema.field("label").type)
            place = np.cumsum(present.to_numpy()) - 1
            places = pa.array(place, mask=~present.to_numpy())
            kept = table.drop_columns(["_routed"])
            yield from kept.append_column(output, lists.take(places)).to_batches()

    return run


def _blocks(left, candidates, k, measure, schema, most, bucket) -> DataFrame:
    """Hits of all queries; one side passes in blocks, the other is read once for each.

    ``most`` are the most queries and the most candidates of a block.  A block's hits are
    written before the next block starts, so one block is held at a time.
    """
    key, *labels = [f.name for f in schema.fields[1:-1]]
    right = _candidate_side(candidates, key, labels, bucket)
    asked, offered = left.count(), right.count()
    passes = [max(1, -(-n // rows)) for n, rows in zip((asked, offered), most)]
    by_query = passes[0] * offered < passes[1] * asked
    by, small, number = ("query_id", left, passes[0]) if by_query else (key, right, passes[1])
    placed = cut_lineage(small.withColumn("_block", F.pmod(F.xxhash64(by), F.lit(number)).cast("int")), by="_block")
    if number > 1:  # the other side is made once, not for each block
        left, right = (left, cut_lineage(right)) if by_query else (cut_lineage(left), right)
        candidates, bucket = (right, bucket and "_buckets") if by_query else (candidates, bucket)
    found = None
    for block in range(number):
        table = placed.where(F.col("_block") == block).drop("_block").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        if by_query:
            restriction = _pushed_buckets(table.column("_routed"), candidates, bucket)
            offer = right.where(restriction) if number > 1 else _candidate_side(candidates.where(restriction), key, labels, bucket)
            part = keep_nearest(_stream_candidates(table, offer, k, measure, schema), k, key)
        else:
            part = _stream_queries(table, left, k, measure, schema)
        part = cut_lineage(part.drop("rank"))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else left.sparkSession.createDataFrame([], schema)
