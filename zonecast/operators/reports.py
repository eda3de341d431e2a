"""Small summaries over the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scalars as S
from zonecast.operators.zones import NOISE, mode_of, value_counts


def severity_distribution(zones: DataFrame) -> DataFrame:
    """Zones and share per band, all four bands kept."""
    spark = zones.sparkSession
    bands = spark.range(len(S.BANDS)).select(
        F.col("id").cast("int").alias("band_order"), S.lookup(F.col("id").cast("int"), dict(enumerate(S.BANDS))).alias("hotspot_band")
    )
    counts = zones.groupBy("hotspot_band").agg(F.count(F.lit(1)).alias("zones"))
    total = zones.agg(F.count(F.lit(1))).scalar()
    n = F.coalesce("zones", F.lit(0))
    return bands.join(counts, "hotspot_band", "left").select(
        "band_order", "hotspot_band", n.alias("zones"), F.coalesce(F.try_divide(n, total) * 100, F.lit(0.0)).alias("share_percent")
    )


def leading_names(zones: DataFrame, band: str = "Very High", k: int = 3) -> DataFrame:
    """Names of the top zones of a band in one text."""
    top = zones.filter(F.col("hotspot_band") == band).orderBy(
        F.desc("hotspot_score"), F.desc("total_violations"), "zone_id"
    ).limit(k)
    ordered = F.sort_array(
        F.collect_list(F.struct((-F.col("hotspot_score")).alias("a"), (-F.col("total_violations")).alias("b"), "zone_id", "zone_name"))
    )
    names = F.transform(ordered, lambda x: x["zone_name"])
    return top.agg(F.array_join(names, ", ").alias("names"))


def top_hotspots(zones: DataFrame, k: int = 10) -> DataFrame:
    return zones.orderBy(F.desc("hotspot_score"), F.desc("total_violations"), "zone_id").limit(k)


def map_summary(zones: DataFrame) -> DataFrame:
    """Zones on the map, critical ones, distinct stations and the worst zone."""
    worst = F.max_by(F.struct("zone_name", "hotspot_score"), F.struct("hotspot_score", "total_violations", "zone_id"))
    return zones.agg(
        F.count(F.lit(1)).alias("zones"), F.count_if(F.col("hotspot_band") == "Very High").alias("very_high"),
        F.countDistinct(F.when(F.col("top_police_station") != "", F.col("top_police_station"))).alias("stations"),
        worst.alias("w"),
    ).select(
        "zones", "very_high", "stations", S.head_of_name(F.col("w.zone_name")).alias("worst_zone"),
        F.col("w.hotspot_score").alias("worst_score"),
    )


def summary_report(labelled: DataFrame, zones: DataFrame) -> DataFrame:
    """Fourteen named metrics as text rows."""
    inside = F.col("zone_id") != NOISE
    counts = labelled.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(inside).alias("in"), F.count_if(~inside).alias("out"),
        F.avg(F.when(inside, F.col("is_peak_hour"))).alias("peak"),
    )
    busiest = value_counts(labelled.filter(inside).withColumn("_all", F.lit(0)), "_all", ["police_station_clean"]).agg(
        mode_of("police_station_clean", "Unknown")
    )
    best = F.max_by(
        F.struct("zone_id", "zone_name", "hotspot_score"),
        F.struct("hotspot_score", "total_violations", -F.regexp_extract("zone_id", r"(\d+)$", 1).cast("long")),
    )
    z = zones.agg(
        F.count(F.lit(1)).alias("n"), best.alias("top"),
        *[F.count_if(F.col("hotspot_band") == b).alias(f"b{i}") for i, b in enumerate(S.BANDS)],
    )
    row = counts.withColumn("z", z.select(F.struct("*")).scalar()).withColumn("station", busiest.scalar())
    metrics = [
        ("Total Violations Processed", F.col("all")),
        ("Clustered Violations (in Zones)", F.col("in")),
        ("Noise Violations (outside Zones)", F.col("out")),
        ("Noise Violations Percentage", S.percent_text(F.coalesce(F.try_divide("out", "all"), F.lit(0.0)), 2)),
        ("Total Geo Clusters (Zones) Detected", F.col("z.n")),
        *[(f"{b} Severity Zones", F.col(f"z.b{i}")) for i, b in enumerate(S.BANDS)],
        ("Most Common Police Station in Hotspots", F.col("station")),
        ("Peak Hour Violations Share in Hotspots", S.percent_text(F.col("peak"), 2)),
        ("Top Hotspot Zone ID", F.col("z.top.zone_id")),
        ("Top Hotspot Zone Name", F.col("z.top.zone_name")),
        ("Top Hotspot Zone Score", F.format_string("%.2f", F.col("z.top.hotspot_score"))),
    ]
    cells = [F.struct(F.lit(n).alias("metric_name"), v.cast("string").alias("metric_value")) for n, v in metrics]
    return row.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def summary_map(report: DataFrame) -> DataFrame:
    """The report as one map; a row per metric bounds it."""
    return report.agg(F.map_from_entries(F.collect_list(F.struct("metric_name", "metric_value"))).alias("summary"))


def kpis(report: DataFrame, best: DataFrame) -> DataFrame:
    """Six headline values in one row."""
    m = summary_map(report).select(F.col("summary").alias("s"), best.select(F.struct("*")).scalar().alias("b"))

    def metric(name):
        return F.element_at("s", F.lit(name))

    return m.select(
        metric("Total Violations Processed").cast("long").alias("total_violations"),
        metric("Total Geo Clusters (Zones) Detected").cast("long").alias("zones"),
        metric("Very High Severity Zones").cast("long").alias("very_high_zones"),
        metric("Peak Hour Violations Share in Hotspots").alias("peak_share"),
        F.col("b.val_p10").alias("best_val_p10"), F.col("b.best_model").alias("best_model"),
    )
