"""Rankings of police stations, junctions and streets over all records, noise included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scalars as S
from zonecast.operators.ordering import with_position
from zonecast.operators.scoring import hotspot_score
from zonecast.session import materialize

ENTITY_KINDS: dict[str, tuple[str, Callable[[Column], Column] | None]] = {
    "Police Station": ("police_station_clean", None),
    "Junction": ("junction_name_clean", S.clean_junction),
    "Street/Location": ("location_first_segment", None),
}
RANKING_COLUMNS = [
    "global_rank", "entity_rank", "entity_type", "entity_name", "hotspot_score", "total_violations",
    "parking_related_violations", "peak_hour_violations", "recency_weight_sum", "location_diversity",
]


def entity_totals(records: DataFrame, kinds: dict = ENTITY_KINDS) -> DataFrame:
    """Sums per (type, name). Counting by location first keeps the distinct count out of any single task."""
    named = [F.struct(F.lit(kind).alias("entity_type"), F.col(c).alias("raw_name")) for kind, (c, _) in kinds.items()]
    measures = ["parking_related_violation_count", "is_peak_hour", "recency_weight"]
    long = records.select("location_clean", *measures, F.explode(F.array(*named)).alias("e"))
    long = long.select("e.entity_type", "e.raw_name", "location_clean", *measures).filter(S.has_name(F.col("raw_name")))
    by_place = long.groupBy("entity_type", "raw_name", "location_clean").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures]
    )
    return by_place.groupBy("entity_type", "raw_name").agg(
        F.sum("n").alias("total_violations"),
        F.sum("parking_related_violation_count").cast("long").alias("parking_related_violations"),
        F.sum("is_peak_hour").cast("long").alias("peak_hour_violations"),
        F.sum("recency_weight").alias("recency_weight_sum"),
        F.count("location_clean").alias("location_diversity"),
    )


def rank_entities(records: DataFrame, kinds: dict = ENTITY_KINDS) -> DataFrame:
    """Score each type on its own scale, rank inside the type and over all types."""
    totals = materialize(entity_totals(records, kinds), "entities")
    scored = hotspot_score(
        totals,
        {
            "total": "total_violations", "parking": "parking_related_violations", "peak": "peak_hour_violations",
            "recency": "recency_weight_sum", "locations": "location_diversity",
        },
        by="entity_type",
    )
    by_score = [F.desc("hotspot_score"), F.desc("total_violations"), F.asc("entity_type"), F.asc("raw_name")]
    placed = with_position(scored, by_score, "_global")
    placed = with_position(placed, [F.asc("entity_type"), F.asc("_global")], "_place")
    # one row per type of `kinds`
    starts = F.broadcast(placed.groupBy("entity_type").agg(F.min("_place").alias("_start")))
    name = F.col("raw_name")
    for kind, (_, cleaner) in kinds.items():
        if cleaner is not None:
            name = F.when(F.col("entity_type") == kind, cleaner(F.col("raw_name"))).otherwise(name)
    ranked = placed.join(starts, "entity_type").withColumns(
        {
            "global_rank": F.col("_global") + 1,
            "entity_rank": F.col("_place") - F.col("_start") + 1,
            "entity_name": name,
        }
    )
    return ranked.select(*RANKING_COLUMNS)


def top_entities(ranking: DataFrame, entity_type: str | None = None, n: int = 50) -> DataFrame:
    chosen = ranking if entity_type is None else ranking.filter(F.col("entity_type") == entity_type)
    return chosen.orderBy("global_rank").limit(n)
