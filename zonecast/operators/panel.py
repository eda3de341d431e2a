"""Dense zone-by-day panel and its lag, rolling, growth and calendar features.

Days are the observed dates of the whole table, not a calendar, and every window counts rows. All windows share one
partitioning and one order, so a single exchange of the daily counts serves the whole feature set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.functions import scalars as S
from zonecast.session import materialize

COUNTS = ["daily_violation_count", "daily_parking_violation_count", "daily_peak_hour_count"]
STATIC_COLUMNS = [
    "zone_name", "centroid_lat", "centroid_lon", "lat_std", "lon_std", "violation_density", "unique_violation_types",
    "unique_vehicle_classes", "unique_locations", "unique_junctions", "recurring_hotspot_flag",
    "month_over_month_trend", "peak_share", "hotspot_band", "top_police_station", "top_junction", "top_location",
    "dominant_time_bucket",
]
# Model inputs, in order.
FEATURES = [
    "centroid_lat", "centroid_lon", "lat_std", "lon_std", "violation_density",
    "unique_violation_types", "unique_vehicle_classes", "unique_locations", "unique_junctions",
    "recurring_hotspot_flag", "month_over_month_trend", "peak_share", "hotspot_band_num",
    "day_of_week", "is_weekend", "month", "week_of_month", "is_peak_season",
    "lag_1_count", "lag_3_count", "lag_7_count", "lag_14_count",
    "rolling_7d_sum", "rolling_7d_mean", "rolling_14d_sum", "rolling_14d_mean",
    "lag_1_parking_count", "rolling_7d_parking_sum", "lag_1_peak_hour_count", "rolling_7d_peak_hour_sum",
    "days_since_last_violation", "count_growth_rate_7d", "count_growth_rate_14d",
]
TARGET = "next_day_violation_count"
NEVER = 90  # rows since the last event when there was none
_REQUIRED = [TARGET, "lag_14_count", "rolling_14d_mean", "count_growth_rate_14d", "days_since_last_violation"]


def daily_counts(
    df: DataFrame, zone: str = "zone_id", day: str = "created_date",
    counted: str = "id", parking: str = "parking_related_violation_count", peak: str = "is_peak_hour",
) -> DataFrame:
    return df.groupBy(F.col(zone).alias("zone_id"), F.col(day).alias("created_date")).agg(
        F.count(counted).alias(COUNTS[0]),
        F.sum(parking).cast("long").alias(COUNTS[1]),
        F.sum(peak).cast("long").alias(COUNTS[2]),
    )


def observed_dates(df: DataFrame, day: str = "created_date") -> Column:
    """Sorted array of the dates of `df` as a scalar subquery; one entry per calendar day bounds its size."""
    days = df.select(F.col(day).alias("d")).filter("d IS NOT NULL").distinct()
    return days.agg(F.sort_array(F.collect_list("d"))).scalar()


#: Dense rows of a task, on average.
TASK_ROWS = 250_000


def dense_panel(daily: DataFrame, dates: Column) -> DataFrame:
    """Every zone of `daily`, a written table, on every date, zero-filled.

    Each zone explodes the date list, so no cross join is planned. Grid and counts are partitioned by zone alone: the
    join needs no further exchange and its order by (zone, date) is the one the feature windows ask for. There are as many
    parts as the dense rows need; left to itself, Spark would size them by the zones before they explode.
    """
    zones = daily.select("zone_id")
    n_dates = daily.sparkSession.range(1).select(F.size(dates).alias("n")).first().n
    least = int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-zones.distinct().count() * max(n_dates, 0) // TASK_ROWS))
    grid = zones.repartition(parts, "zone_id").distinct().select("zone_id", F.posexplode(dates).alias("date_index", "created_date"))
    joined = grid.join(daily.repartition(parts, "zone_id"), ["zone_id", "created_date"], "left")
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return joined.select("zone_id", "created_date", "date_index", *filled)


def _order() -> Window:
    return Window.partitionBy("zone_id").orderBy("created_date")


def rows_since_last_positive(column: str, index: str, window: Window, default: int = NEVER) -> Column:
    """Rows back to the last earlier row with a positive value."""
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col(column) > 0, F.col(index)), ignorenulls=True).over(earlier)
    return F.coalesce((F.col(index) - seen).cast("long"), F.lit(default).cast("long"))


def lag_features(panel: DataFrame) -> DataFrame:
    w = _order()
    count, parking, peak = COUNTS
    return panel.withColumns(
        {
            "prev_day_count": F.lag(count, 1).over(w), "prev_day_parking": F.lag(parking, 1).over(w),
            "prev_day_peak": F.lag(peak, 1).over(w),
            "lag_1_count": F.lag(count, 1).over(w), "lag_3_count": F.lag(count, 3).over(w),
            "lag_7_count": F.lag(count, 7).over(w), "lag_14_count": F.lag(count, 14).over(w),
            "lag_1_parking_count": F.lag(parking, 1).over(w), "lag_1_peak_hour_count": F.lag(peak, 1).over(w),
        }
    )


def rolling_features(panel: DataFrame) -> DataFrame:
    """Sums and means of the 7 and 14 rows before the current one; null until there are that many.

    Counts are whole numbers, so a rolling sum is the exact difference of two running totals. That costs one pass,
    where a sliding frame would add up its rows anew at every row.
    """
    w = _order()
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    totals = dict(zip(COUNTS, ("_count_total", "_parking_total", "_peak_total")))
    run = panel.withColumns({t: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c, t in totals.items()})

    def rolling(column: str, n: int) -> Column:
        total = totals[column]
        return F.when(F.col("date_index") >= n, F.col(total) - F.lag(total, n).over(w))

    count, parking, peak = COUNTS
    sums = run.withColumns(
        {
            "rolling_7d_sum": rolling(count, 7), "rolling_14d_sum": rolling(count, 14),
            "rolling_7d_parking_sum": rolling(parking, 7), "rolling_7d_peak_hour_sum": rolling(peak, 7),
        }
    ).drop(*totals.values())
    return sums.withColumns({f"rolling_{n}d_mean": F.col(f"rolling_{n}d_sum") / n for n in (7, 14)})


def recency_feature(panel: DataFrame) -> DataFrame:
    return panel.withColumn(
        "days_since_last_violation", rows_since_last_positive(COUNTS[0], "date_index", _order())
    )


def growth_features(panel: DataFrame) -> DataFrame:
    """Change of the rolling mean against the same mean one window earlier."""

    def growth(n: int) -> Column:
        mean = F.col(f"rolling_{n}d_mean")
        before = F.lag(mean, n).over(_order())
        return (mean - before) / (before + 1e-5)

    return panel.withColumns({f"count_growth_rate_{n}d": growth(n) for n in (7, 14)})


def target_feature(panel: DataFrame) -> DataFrame:
    return panel.withColumn(TARGET, F.lead(COUNTS[0], 1).over(_order()))


def calendar_features(panel: DataFrame, season: tuple[int, ...] = S.PEAK_SEASON) -> DataFrame:
    day = F.col("created_date")
    return panel.withColumns(
        {
            "day_of_week": S.weekday_number(day), "is_weekend": S.weekend_flag(day), "month": F.month(day),
            "week_of_month": S.week_of_month(day), "is_peak_season": S.peak_season_flag(day, season),
        }
    )


def time_features(panel: DataFrame) -> DataFrame:
    """All features that need only the panel itself."""
    windows = target_feature(growth_features(recency_feature(rolling_features(lag_features(panel)))))
    return calendar_features(windows)


def add_static(panel: DataFrame, zones: DataFrame) -> DataFrame:
    """Static zone columns and the band as a number."""
    joined = panel.join(zones.select("zone_id", *STATIC_COLUMNS), "zone_id", "left")
    return joined.withColumn("hotspot_band_num", S.lookup(F.col("hotspot_band"), S.BAND_NUMBER, 1))


def daily_cube(labelled: DataFrame) -> DataFrame:
    """Counts of each zone and date, noise included, written: the one reading of the records that the panel needs."""
    return materialize(daily_counts(labelled).filter("created_date IS NOT NULL"), "cube")


def panel_of(cube: DataFrame) -> DataFrame:
    """Clustered zones on all dates of the cube, noise dates included."""
    from zonecast.operators.zones import clustered

    return dense_panel(clustered(cube), observed_dates(cube))


def zone_daily_features(cube: DataFrame, zones: DataFrame) -> DataFrame:
    """The feature table of a `daily_cube`."""
    return add_static(time_features(panel_of(cube)), zones).drop("date_index")


#: Rows before a day that its windows may look at: the mean of 14 rows, 14 rows back.
LOOKBACK = 28


def appended_features(cube: DataFrame, zones: DataFrame, first_new: str) -> DataFrame:
    """`zone_daily_features` of the dates from the one before `first_new` on, which is the first whose target may have changed.

    Only the tail of the cube that the windows reach is made dense. What lies before it and still matters, the last positive
    row of a zone, comes from one aggregate of the cube. The zones must be those of the stored panel.
    """
    from zonecast.operators.zones import clustered

    dates = [r.d for r in cube.select(F.col("created_date").alias("d")).distinct().orderBy("d").collect()]  # a row per calendar day
    new = next((i for i, d in enumerate(dates) if str(d) >= first_new), len(dates))
    start = max(new - 1, 0)
    tail = max(start - LOOKBACK, 0)
    index = F.create_map(*[x for i, d in enumerate(dates) for x in (F.lit(d), F.lit(i))])
    daily = clustered(cube)
    before = daily.filter((F.col("created_date") < F.lit(dates[tail])) & (F.col(COUNTS[0]) > 0)).groupBy("zone_id").agg(
        F.max("created_date").alias("_d")
    ).select("zone_id", F.element_at(index, F.col("_d")).alias("_seen"))
    every = daily.select("zone_id").distinct()
    grid = every.select("zone_id", F.explode(F.array(*[F.lit(d) for d in dates[tail:]])).alias("created_date"))
    rows = grid.join(daily.filter(F.col("created_date") >= F.lit(dates[tail])), ["zone_id", "created_date"], "left").select(
        "zone_id", "created_date", F.element_at(index, F.col("created_date")).alias("date_index"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
    )
    made = time_features(rows).join(before, "zone_id", "left")
    carried = F.coalesce((F.col("date_index") - F.col("_seen")).cast("long"), F.lit(NEVER).cast("long"))
    # none in the tail: the last one before it
    inside = F.sum(F.when(F.col(COUNTS[0]) > 0, 1).otherwise(0)).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    made = made.withColumn("days_since_last_violation", F.when(F.coalesce(inside, F.lit(0)) > 0, F.col("days_since_last_violation")).otherwise(carried))
    return add_static(made.filter(F.col("created_date") >= F.lit(dates[start])).drop("_seen"), zones).drop("date_index")


def modeling_rows(features: DataFrame) -> DataFrame:
    """Rows with a target and a full history."""
    return features.na.drop(subset=_REQUIRED)
