"""Congestion impact of zones and the queries of the map and ranking pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scalars as S
from zonecast.operators.ordering import with_position
from zonecast.operators.scoring import log_minmax

MAP_COLUMNS = [
    "zone_id", "zone_name", "latitude", "longitude", "total_violations", "parking_related_violations",
    "hotspot_score", "hotspot_band", "top_police_station", "top_location", "dominant_time_bucket", "dominant_hour",
    "peak_share",
]
POPUP_COLUMNS = [
    "predicted_next_day_violations", "predicted_risk_score", "predicted_risk_band", "recommended_action",
    "manpower_estimate", "time_window_to_watch",
]


def impact(zones: DataFrame) -> DataFrame:
    """Impact score and road capacity loss from density, peak share, junction, road type and vehicle mix."""
    tops = zones.agg(
        F.struct(F.max("violation_density").alias("density"), F.max("unique_vehicle_classes").alias("classes"))
    ).scalar()
    z = zones.withColumn("_top", tops)

    def share_of(column: str, top: str) -> Column:
        largest = F.col(f"_top.{top}")
        return F.col(column) / F.when(largest == 0, 1).otherwise(largest) * 100

    junction = F.when(F.col("top_junction").isNotNull() & (F.col("top_junction") != S.NO_JUNCTION), 100).otherwise(30)
    score = (
        share_of("violation_density", "density") * 0.30 + F.col("peak_share") * 100 * 0.25 + junction * 0.20
        + S.road_weight(F.col("zone_name")) * 0.15
        + F.least(F.lit(100.0), share_of("unique_vehicle_classes", "classes")) * 0.10
    )
    z = z.withColumn("impact_score", S.round_half_up(score * 10) / 10).drop("_top")
    loss = F.col("impact_score") * 0.7 + F.when(F.col("total_violations") > 12000, 12).otherwise(0)
    return z.withColumns(
        {
            "capacity_loss": S.clamp(S.round_half_up(loss), 5, 85).cast("int"),
            "peak_label": S.peak_label(F.col("dominant_time_bucket")),
            "short_name": S.head_of_name(F.col("zone_name")),
            "chart_label": S.short_label(F.col("zone_name")),
        }
    )


def top_impact(scored: DataFrame, k: int = 10) -> DataFrame:
    return scored.orderBy(F.desc("impact_score"), "zone_id").limit(k)


def city_impact(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.avg("impact_score").alias("mean_impact"), F.avg("capacity_loss").alias("mean_loss"),
        F.count_if(F.col("impact_score") > 65).alias("choke_points"),
    )


def alternative_impact(zones: DataFrame) -> DataFrame:
    """Four-part score of the design notes with the deployment its thresholds ask for."""
    parts = {
        "total_violations": 0.4, "peak_hour_violations": 0.2, "unique_vehicle_classes": 0.2, "recency_weight_sum": 0.2
    }
    scaled = log_minmax(zones, list(parts))
    score = sum(F.col(f"norm_{c}") * w for c, w in parts.items())
    scored = scaled.withColumn("alt_impact", S.round_half_even(score * 100, 2))
    return scored.select("zone_id", "alt_impact", S.threshold_action(F.col("alt_impact")).alias("alt_action"))


def map_layer(
    zones: DataFrame, band: str | None = None, station: str | None = None, bucket: str | None = None
) -> DataFrame:
    """Map columns of the zones that pass the given filters, with marker size and colours."""
    layer = zones.withColumnsRenamed({"centroid_lat": "latitude", "centroid_lon": "longitude"}).select(*MAP_COLUMNS)
    wanted = {"hotspot_band": band, "top_police_station": station, "dominant_time_bucket": bucket}
    for column, value in wanted.items():
        if value is not None:
            layer = layer.filter(F.col(column) == value)
    return layer.withColumns(
        {
            "marker_radius": S.marker_radius(F.col("total_violations")),
            "band_style": S.band_style(F.col("hotspot_band")), "band_colour": S.band_colour(F.col("hotspot_band")),
        }
    )


def map_popup(layer: DataFrame, recs: DataFrame) -> DataFrame:
    return layer.join(recs.select("zone_id", *POPUP_COLUMNS), "zone_id", "left")


def stations(zones: DataFrame) -> DataFrame:
    """Stations offered as a filter, sorted."""
    named = zones.filter(F.col("top_police_station") != "")
    return named.select("top_police_station").distinct().orderBy("top_police_station")


def zone_inspector(errors: DataFrame, recs: DataFrame, zones: DataFrame) -> DataFrame:
    """Error, deployment and zone facts per zone; zones without a recommendation show no officers."""
    r = recs.select("zone_id", F.col("zone_name").alias("_rn"), F.col("top_police_station").alias("_rs"),
                    "manpower_estimate", "time_window_to_watch")
    z = zones.select("zone_id", F.col("zone_name").alias("_zn"), F.col("top_police_station").alias("_zs"))
    none = F.lit("—")
    officers = F.when(F.col("manpower_estimate") > 0, F.col("manpower_estimate").cast("string"))
    return errors.join(r, "zone_id", "left").join(z, "zone_id", "left").select(
        "zone_id", F.coalesce("_rn", "_zn", none).alias("zone_name"),
        F.coalesce("_rs", "_zs", none).alias("police_station"), "actual", "predicted", "absolute_error",
        F.coalesce(officers, F.lit("0 officers")).alias("manpower"),
        F.coalesce("time_window_to_watch", none).alias("watch_window"),
    )


def sort_by_any(df: DataFrame, column: str, key: str, descending: bool = False) -> DataFrame:
    """Add `position`, the place from 0 in the order of `column`: as numbers where the text (without thousands commas) parses, then as text.

    `key` is unique and breaks ties.
    """
    text = F.col(column).cast("string")
    parsed = F.regexp_replace(text, ",", "").try_cast("double")
    order = [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in (parsed, text)]
    return with_position(df, [*order, F.col(key)])
