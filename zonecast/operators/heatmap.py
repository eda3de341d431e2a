"""Weekday by hour counts as a dense table and as a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scalars as S

_DAY_NAMES = {i: d for i, d in enumerate(S.DAYS)}


def temporal_heatmap(records: DataFrame) -> DataFrame:
    """168 rows `day_of_week, day_name, hour, violation_count`; empty cells are 0."""
    counts = records.groupBy(
        F.col("created_day_of_week").alias("day_of_week"), F.col("created_hour").alias("hour")
    ).agg(F.count(F.lit(1)).alias("violation_count"))
    cell = F.col("id")
    grid = records.sparkSession.range(7 * 24).select(
        F.floor(cell / 24).cast("int").alias("day_of_week"), (cell % 24).cast("int").alias("hour")
    )
    return grid.join(counts, ["day_of_week", "hour"], "left").select(
        "day_of_week", S.lookup(F.col("day_of_week"), _DAY_NAMES).alias("day_name"), "hour",
        F.coalesce("violation_count", F.lit(0)).alias("violation_count"),
    )


def heatmap_matrix(heat: DataFrame) -> DataFrame:
    """One row per weekday in calendar order, one column `h0..h23` per hour."""
    wide = heat.groupBy("day_of_week", "day_name").pivot("hour", list(range(24))).agg(F.sum("violation_count"))
    return wide.withColumnsRenamed({str(h): f"h{h}" for h in range(24)}).orderBy("day_of_week")


def heatmap_peaks(heat: DataFrame) -> DataFrame:
    """Fullest cell (the first of equals), grand total and busiest day."""
    first = F.max_by(
        F.struct("day_name", "hour", "violation_count"),
        F.struct("violation_count", -(F.col("day_of_week") * 24 + F.col("hour"))),
    )
    top = heat.agg(first.alias("peak"), F.sum("violation_count").alias("total_count"))
    days = heat.groupBy("day_of_week", "day_name").agg(F.sum("violation_count").alias("n"))
    busiest = F.max_by(F.struct("day_name", "n"), F.struct("n", -F.col("day_of_week")))
    return top.withColumn("busiest", days.agg(busiest).scalar()).select(
        F.col("peak.day_name").alias("peak_day"), F.col("peak.hour").alias("peak_hour"),
        F.col("peak.violation_count").alias("peak_count"), "total_count",
        F.col("busiest.day_name").alias("busiest_day"), F.col("busiest.n").alias("busiest_day_count"),
    )


def heat_intensity(heat: DataFrame) -> DataFrame:
    """Intensity class and hour labels of each cell."""
    largest = heat.agg(F.max("violation_count")).scalar()
    return heat.select(
        "day_of_week", "hour", S.hour_label(F.col("hour")).alias("hour_label"),
        S.hour_range(F.col("hour")).alias("hour_range"), F.substring("day_name", 1, 3).alias("day_label"),
        S.heat_class(F.col("violation_count"), largest).alias("heat_class"), "violation_count",
    )
