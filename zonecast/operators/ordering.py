"""Positions in a total order without moving the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.session import materialize

_INDEX_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in `order`, which must be total (end it with a unique column).

    The table is range-partitioned on the sort key, each partition numbers its own rows, and the partition sizes (one
    row per partition) give the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_seq", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_part", F.shiftright("_seq", _INDEX_BITS))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    index = F.col("_seq").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + index)
        .drop("_part", "_seq", "_offset")
    )


def bounded_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """`with_position` in one task, for tables whose rows are bounded by design (a top-k, dates, models)."""
    return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the 1-based rank of `value`, ascending; equal values share the mean of the ranks they span, nulls have none."""
    # rank the distinct values only: a value shared by a third of the rows is one row here
    counted = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_ties"))
    placed = running_total(counted, [F.col(value)], "_ties", "_upto")
    ranks = placed.select(value, (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(name))
    return df.join(ranks, value, "left")


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add the inclusive running sum of the integer column `value` in `order`, a total order.

    Same two steps as `with_position`: sums inside range partitions, then one offset per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.withColumn("_inside", F.sum(value).over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_inside", "_offset")
    )
