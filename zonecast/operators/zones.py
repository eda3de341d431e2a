"""Zones: naming of clusters, one wide row per zone, score and band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scalars as S
from zonecast.functions.geo import haversine_m
from zonecast.operators.dbscan import Clustering
from zonecast.operators.ordering import with_position
from zonecast.operators.scoring import band_by_position, hotspot_score
from zonecast.session import materialize

NOISE = "ZONE_NOISE"

# Text fields of a zone and the defaults of their modes.
TEXT_FIELDS = {
    "police_station_clean": "Unknown Station", "junction_name_clean": S.NO_JUNCTION, "location_clean": "Unknown Street",
    "location_first_segment": "Unknown Street", "time_bucket": "midday", "created_day_name": "Monday",
    "created_hour": "12", "primary_violation": None, "vehicle_class": None,
}
LEADING = [
    "zone_id", "zone_name", "centroid_lat", "centroid_lon", "lat_std", "lon_std", "total_violations",
    "parking_related_violations", "non_parking_violations", "violation_density", "hotspot_score", "hotspot_band",
    "top_police_station", "top_junction", "top_location",
]
MONTH_COLUMNS = [f"violations_{m[:3]}" for m in S.MONTHS]


def zone_numbers(clustering: Clustering) -> DataFrame:
    """`component, zone_id, records`: zones numbered by record count, ties by their first core point."""
    sizes = materialize(
        clustering.nodes.filter("component IS NOT NULL").groupBy("component").agg(F.sum("weight").alias("records")),
        "sizes",
    )
    placed = with_position(sizes, [F.desc("records"), F.asc("component")], "_position")
    return placed.withColumn("zone_id", F.format_string("ZONE_%03d", F.col("_position") + 1)).drop("_position")


def label_records(records: DataFrame, clustering: Clustering) -> DataFrame:
    """Records with `zone_id`; records outside every cluster get ZONE_NOISE."""
    numbers = materialize(zone_numbers(clustering).select("component", "zone_id"), "zone_numbers")
    labelled = clustering.label_records(records, numbers)
    return labelled.withColumn("zone_id", F.coalesce("zone_id", F.lit(NOISE)))


def clustered(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("zone_id") != NOISE)


def value_counts(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`key, field, value, n` for every non-null value, counted before the shuffle.

    Modes and distinct counts of all fields follow from this one table, so no task holds the values of a whole group.
    """
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    long = df.select(key, F.explode(F.array(*cells)).alias("cell")).select(key, "cell.field", "cell.value")
    return long.filter("value IS NOT NULL").groupBy(key, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def _is(field: str) -> Column:
    return F.col("field") == field


def mode_of(field: str, default=None, without: str | None = None, numeric: bool = False) -> Column:
    """Most frequent value of `field` over `value_counts` rows; the smallest of equally frequent ones."""
    value = F.col("value").cast("int") if numeric else F.col("value")
    keep = _is(field) if without is None else _is(field) & (F.col("value") != without)
    best = F.min(F.when(keep, F.struct((-F.col("n")).alias("minus_n"), value.alias("value"))))["value"]
    return best if default is None else F.coalesce(best, F.lit(int(default) if numeric else default))


def distinct_of(field: str) -> Column:
    return F.count_if(_is(field))


def zone_modes(labelled: DataFrame) -> DataFrame:
    """Dominant values and distinct counts per zone."""
    counts = value_counts(clustered(labelled), "zone_id", list(TEXT_FIELDS))

    def mode(field, **kw):
        return mode_of(field, TEXT_FIELDS[field], **kw)

    return counts.groupBy("zone_id").agg(
        mode("police_station_clean").alias("top_police_station"),
        mode("junction_name_clean", without=S.NO_JUNCTION).alias("top_junction"),
        mode("location_clean").alias("top_location"),
        mode("location_first_segment").alias("top_segment"),
        mode("created_hour", numeric=True).alias("dominant_hour"),
        mode("time_bucket").alias("dominant_time_bucket"),
        mode("created_day_name").alias("dominant_day_name"),
        distinct_of("primary_violation").alias("unique_violation_types"),
        distinct_of("vehicle_class").alias("unique_vehicle_classes"),
        distinct_of("location_clean").alias("unique_locations"),
        distinct_of("junction_name_clean").alias("unique_junctions"),
    )


def zone_totals(labelled: DataFrame) -> DataFrame:
    """Counts, sums and coordinate spread per zone in one hash aggregate."""
    month = F.lower("created_month_name")

    def total(c, name):
        return F.sum(c).cast("long").alias(name)

    return clustered(labelled).groupBy("zone_id").agg(
        F.avg("latitude").alias("centroid_lat"), F.avg("longitude").alias("centroid_lon"),
        F.coalesce(F.stddev_samp("latitude"), F.lit(0.0)).alias("lat_std"),
        F.coalesce(F.stddev_samp("longitude"), F.lit(0.0)).alias("lon_std"),
        F.min("latitude").alias("lat_lo"), F.max("latitude").alias("lat_hi"),
        F.min("longitude").alias("lon_lo"), F.max("longitude").alias("lon_hi"),
        F.count(F.lit(1)).alias("total_violations"),
        total("parking_related_violation_count", "parking_related_violations"),
        total("non_parking_violation_count", "non_parking_violations"),
        total("is_peak_hour", "peak_hour_violations"),
        total("is_morning_peak", "morning_peak_violations"),
        total("is_evening_peak", "evening_peak_violations"),
        total("is_weekend", "weekend_violations"),
        total(1 - F.col("is_weekend"), "weekday_violations"),
        F.count_if(F.col("time_bucket") == "night").alias("night_violations"),
        F.sum("recency_weight").alias("recency_weight_sum"),
        *[F.count_if(month == m).alias(c) for m, c in zip(S.MONTHS, MONTH_COLUMNS)],
    )


def zone_geometry(totals: DataFrame) -> DataFrame:
    """Area of the bounding box, at least 100 square metres, and records per square metre."""
    width = haversine_m(F.col("centroid_lat"), F.col("lon_lo"), F.col("centroid_lat"), F.col("lon_hi"))
    height = haversine_m(F.col("lat_lo"), F.col("centroid_lon"), F.col("lat_hi"), F.col("centroid_lon"))
    sized = totals.withColumn("area_m2", F.greatest(width * height, F.lit(100.0)))
    return sized.withColumn("violation_density", S.round_half_even(F.col("total_violations") / F.col("area_m2"), 6))


def trend_columns(zones: DataFrame) -> DataFrame:
    """Slope of the monthly counts relative to the monthly mean, and the recurring flag."""
    middle = (len(MONTH_COLUMNS) - 1) / 2
    spread = sum((i - middle) ** 2 for i in range(len(MONTH_COLUMNS)))
    slope = sum(F.col(c) * (i - middle) for i, c in enumerate(MONTH_COLUMNS)) / spread
    mean = F.col("total_violations") / float(len(MONTH_COLUMNS))
    active = sum((F.col(c) > 0).cast("int") for c in MONTH_COLUMNS)
    return zones.withColumns(
        {
            "month_over_month_trend": S.round_half_even(F.when(mean > 0, slope / mean).otherwise(0.0), 4),
            "recurring_hotspot_flag": ((active >= 3) & (F.col("total_violations") >= 15)).cast("int"),
        }
    )


def lead_with(df: DataFrame, first: list[str]) -> DataFrame:
    return df.select(*first, *[c for c in df.columns if c not in first])


def hotspot_zones(labelled: DataFrame) -> DataFrame:
    """The zone table: 38 columns, scored and banded."""
    merged = trend_columns(zone_geometry(zone_totals(labelled))).join(zone_modes(labelled), "zone_id")
    merged = merged.withColumns(
        {
            "peak_share": S.round_half_even(F.col("peak_hour_violations") / F.col("total_violations"), 4),
            "zone_name": S.zone_name(F.col("top_junction"), F.col("top_segment"), F.col("top_police_station")),
        }
    ).drop("lat_lo", "lat_hi", "lon_lo", "lon_hi", "area_m2", "top_segment")
    merged = materialize(merged, "zone_rows")
    scored = hotspot_score(
        merged,
        {
            "total": "total_violations", "parking": "parking_related_violations", "peak": "peak_hour_violations",
            "recency": "recency_weight_sum", "locations": "unique_locations",
        },
    )
    order = [F.desc("hotspot_score"), F.desc("total_violations"), F.asc("zone_id")]
    banded = band_by_position(scored, order, merged.count())
    return lead_with(banded, LEADING)


def noise_stats(labelled: DataFrame) -> DataFrame:
    per_zone = labelled.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))
    noise = F.sum(F.when(F.col("zone_id") == NOISE, F.col("n")).otherwise(0))
    return per_zone.agg(
        F.count_if(F.col("zone_id") != NOISE).alias("n_zones"),
        F.coalesce(noise, F.lit(0)).alias("noise_records"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("all_records"),
        S.round_half_even(noise / F.sum("n") * 100, 2).alias("noise_percent"),
    )


def grid_cells(records: DataFrame, k: int = 5) -> DataFrame:
    """The `k` fullest grid cells and the number of cells in the whole grid."""
    cells = records.groupBy("geo_cell").agg(F.count(F.lit(1)).alias("n"))
    n_cells = cells.agg(F.count(F.lit(1))).scalar()
    return cells.orderBy(F.desc("n"), F.asc("geo_cell")).limit(k).withColumn("n_cells", n_cells)


def check_conservation(input_rows: DataFrame, labelled: DataFrame, quarantined: DataFrame) -> DataFrame:
    """One row; fails at run time unless every input record is in a zone, noise or quarantine and scores fit."""
    n_in = input_rows.agg(F.count(F.lit(1))).scalar()
    n_bad = quarantined.agg(F.count(F.lit(1))).scalar()
    sides = labelled.agg(
        F.count_if(F.col("zone_id") != NOISE).alias("clustered"), F.count_if(F.col("zone_id") == NOISE).alias("noise")
    )
    counted = sides.withColumn("quarantined", n_bad).withColumn("input", n_in)
    holds = F.col("clustered") + F.col("noise") + F.col("quarantined") == F.col("input")
    checked = F.coalesce(F.assert_true(holds, "records lost or duplicated").cast("long"), F.col("input"))
    return counted.withColumn("input", checked)


def check_scores(zones: DataFrame) -> DataFrame:
    """One row with the score range; fails at run time if a score leaves 0..100."""
    ends = zones.agg(F.min("hotspot_score").alias("min_score"), F.max("hotspot_score").alias("max_score"))
    holds = (F.col("min_score") >= 0) & (F.col("max_score") <= 100)
    checked = F.coalesce(F.assert_true(holds, "score outside 0..100").cast("double"), F.col("max_score"))
    return ends.withColumn("max_score", checked)
