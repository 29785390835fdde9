"""Numbering and running totals over a global order, without a one-task window.

Rows are range-partitioned on the order, which must end in a unique column so
that equal leading values can be spread.  The partitioned keys are written out
once (a second evaluation could draw other range bounds); then only one row per
partition is needed to turn local positions into global ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearkin.session import cut_lineage


def number_rows(frame: DataFrame, order: list[Column], output: str, after: int = 0) -> DataFrame:
    """Add the position of each row, counted from ``after + 1``; all given columns are shuffled and written once."""
    # The low 33 bits of the generated id count the rows of a partition, the others name it.
    placed = cut_lineage(
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .withColumn("_place", F.col("_at") - F.shiftleft(F.col("_part"), 33))
        .drop("_at")
    )
    # one row per partition, so this window may run in one task
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    return (
        placed.join(starts, "_part")
        .withColumn(output, F.col("_start") + F.col("_place") + (after + 1))
        .drop("_part", "_place", "_start")
    )


def totals_before(
    frame: DataFrame, order: str, values: list[str], within: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``<value>_before``: the sum over rows with a smaller ``order``, per group."""
    placed = cut_lineage(
        frame.repartitionByRange(*within, order).withColumn("_part", F.spark_partition_id())
    )
    upto = (Window.unboundedPreceding, -1)
    groups = [*within, "_part"]
    by_part = Window.partitionBy(*within).orderBy("_part").rowsBetween(*upto)
    starts = placed.groupBy(*groups).agg(*[F.sum(v).alias(v) for v in values]).select(
        *groups, *[F.coalesce(F.sum(v).over(by_part), F.lit(0)).alias(f"_{v}") for v in values]
    )
    local = Window.partitionBy(*groups).orderBy(order).rowsBetween(*upto)
    summed = placed.withColumns(
        {f"{v}_before": F.coalesce(F.sum(v).over(local), F.lit(0)) for v in values}
    ).join(starts, groups)
    return summed.withColumns(
        {f"{v}_before": F.col(f"{v}_before") + F.col(f"_{v}") for v in values}
    ).drop("_part", *[f"_{v}" for v in values])
