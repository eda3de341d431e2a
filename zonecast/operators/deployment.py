"""Risk bands, recommendations and the allocation of limited staff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.functions import scalars as S
from zonecast.operators.ordering import average_rank, bounded_position

FORECAST = "predicted_next_day_violations"
RECOMMENDATION_COLUMNS = [
    "zone_id", "zone_name", "top_police_station", "top_junction", "top_location", FORECAST, "predicted_risk_score",
    "predicted_risk_band", "recommended_action", "manpower_estimate", "time_window_to_watch",
]


def risk_order() -> list:
    return [F.desc("predicted_risk_score"), F.desc(FORECAST), F.asc("zone_id")]


def last_day(features: DataFrame, day=None) -> DataFrame:
    """Rows of the last feature day, or of `day`."""
    return features.filter(F.col("created_date") == (features.agg(F.max("created_date")).scalar() if day is None else day))


def risk_percentiles(forecast: DataFrame) -> DataFrame:
    """Round the forecast `yhat` and add its percentile with equal values sharing their mean rank; no forecast, no rank."""
    rounded = forecast.withColumn(FORECAST, S.round_half_even(F.when(F.col("yhat").isNotNull(), F.greatest("yhat", F.lit(0.0))), 2))
    n = rounded.agg(F.count(F.lit(1))).scalar()
    ranked = average_rank(rounded, FORECAST, "_rank")
    return ranked.withColumn("predicted_pct", F.col("_rank") / n).drop("_rank")


def risk_scores(forecast: DataFrame) -> DataFrame:
    """Band by percentile, then lift rising zones of the two upper hotspot bands.

    "Rising" compares the forecast with `lag_1_count`, as the source rule does.
    """
    scored = risk_percentiles(forecast).withColumns(
        {
            "predicted_risk_score": S.round_half_even(F.col("predicted_pct") * 100, 1),
            "predicted_risk_band": F.when(F.col("predicted_pct").isNotNull(), S.risk_band(F.col("predicted_pct"))),
        }
    )
    rising = F.col(FORECAST) > F.col("lag_1_count")
    top = rising & (F.col("hotspot_band") == "Very High")
    second = rising & (F.col("hotspot_band") == "High") & F.col("predicted_risk_band").isin("Medium", "Low")

    def lifted(column, very_high, high):
        return F.when(top, very_high).when(second, high).otherwise(F.col(column))

    score = F.col("predicted_risk_score")
    return scored.withColumns(
        {
            "predicted_risk_score": lifted(
                "predicted_risk_score", F.greatest(score, F.lit(S.RISK_FLOORS["Very High"])),
                F.greatest(score, F.lit(S.RISK_FLOORS["High"])),
            ),
            "predicted_risk_band": lifted("predicted_risk_band", F.lit("Very High"), F.lit("High")),
        }
    )


def recommendations(forecast: DataFrame) -> DataFrame:
    """Deployment table from last-day features with a forecast column `yhat`."""
    band = F.col("predicted_risk_band")
    return risk_scores(forecast).withColumns(
        {
            "recommended_action": S.lookup(band, S.ACTIONS),
            "manpower_estimate": S.lookup(band, S.MANPOWER),
            "time_window_to_watch": S.lookup(F.col("dominant_time_bucket"), S.WATCH_WINDOWS, S.DEFAULT_WINDOW),
        }
    ).select(*RECOMMENDATION_COLUMNS)


def top_deployments(recs: DataFrame, k: int = 10) -> DataFrame:
    towing = F.lower("recommended_action").contains("towing").cast("int")
    return recs.withColumn("needs_towing", towing).orderBy(*risk_order()).limit(k)


def forecast_table(recs: DataFrame, band: str | None = None) -> DataFrame:
    return recs if band is None else recs.filter(F.col("predicted_risk_band") == band)


def compare_top(old: DataFrame, new: DataFrame, k: int = 10) -> DataFrame:
    """The top `k` of two recommendation tables side by side, matched by place."""

    def top(recs: DataFrame, side: str) -> DataFrame:
        best = recs.orderBy(*risk_order()).limit(k)
        columns = ["zone_id", FORECAST, "predicted_risk_score", "predicted_risk_band"]
        return bounded_position(best, risk_order(), "place").select(
            (F.col("place") + 1).alias("place"), *[F.col(c).alias(f"{side}_{c}") for c in columns]
        )

    return top(old, "old").join(top(new, "new"), "place", "full")


def _requirement(recs: DataFrame) -> DataFrame:
    band = F.col("predicted_risk_band")
    return recs.withColumn("officers_required", S.lookup(band, S.MANPOWER, 0)).withColumn(
        "trucks_required", S.lookup(band, S.TOW_TRUCKS, 0)
    )


def allocate(recs: DataFrame, officers: int, trucks: int) -> DataFrame:
    """Give officers and tow trucks to zones in risk order until they run out.

    Every served zone takes at least one officer, so only the first `officers` zones that need any can be served. That
    top-k bounds the running sums; the rest of the table gets nothing and is not returned.
    """
    queue = _requirement(recs).filter("officers_required > 0").orderBy(*risk_order()).limit(max(officers, 0))
    before = Window.orderBy(*risk_order()).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("officers_required").over(before), F.lit(0))
    served = queue.withColumn(
        "officers_assigned", F.greatest(F.lit(0), F.least(F.col("officers_required"), officers - used))
    ).filter("officers_assigned > 0")
    asked = F.coalesce(F.sum("trucks_required").over(before), F.lit(0))
    return served.withColumn(
        "trucks_assigned", F.when((F.col("trucks_required") > 0) & (asked < trucks), 1).otherwise(0)
    ).select(
        "zone_id", "zone_name", "predicted_risk_band", "predicted_risk_score", FORECAST, "officers_required",
        "officers_assigned", "trucks_assigned",
        S.round_half_up(F.col("officers_assigned") / F.col("officers_required") * 100).alias("coverage_pct"),
    )


def top_allocations(plan: DataFrame, k: int = 6) -> DataFrame:
    """The first `k` served zones in risk order with their place, short name and what they get."""
    first = plan.orderBy(*risk_order()).limit(k)
    return bounded_position(first, risk_order(), "place").select(
        (F.col("place") + 1).alias("place"), "zone_id", S.head_of_name(F.col("zone_name")).alias("short_name"), "predicted_risk_band",
        "officers_assigned", (F.col("trucks_assigned") > 0).cast("int").alias("towed"), "coverage_pct",
    )


def coverage(recs: DataFrame, officers: int, trucks: int, historical_pct: float = 42.5) -> DataFrame:
    """Share of the forecast covered by the allocation, against a random patrol and a fixed historical plan."""
    plan = allocate(recs, officers, trucks)
    covered = plan.agg(
        F.coalesce(F.sum(F.col(FORECAST) * F.col("officers_assigned") / F.col("officers_required")), F.lit(0.0)).alias("c"),
        F.count(F.lit(1)).alias("zones"), F.coalesce(F.sum("officers_assigned"), F.lit(0)).alias("used"),
        F.coalesce(F.sum("trucks_assigned"), F.lit(0)).alias("tows"),
    )
    whole = recs.agg(F.struct(F.sum(FORECAST).alias("v"), F.count(F.lit(1)).alias("n"))).scalar()
    both = covered.withColumn("whole", whole)
    guided = F.when(F.col("whole.v") > 0, F.col("c") / F.col("whole.v") * 100).otherwise(0.0)
    patrol = S.clamp(F.coalesce(F.try_divide("zones", "whole.n"), F.lit(0.0)) * 40 + 6, 5.0, 25.0)
    return both.select(
        guided.alias("guided_pct"), patrol.alias("random_pct"), F.lit(historical_pct).alias("historical_pct"),
        (guided / patrol).alias("multiplier"), F.col("zones").alias("zones_served"),
        F.col("used").alias("officers_deployed"), F.col("tows").alias("trucks_deployed"),
    )
