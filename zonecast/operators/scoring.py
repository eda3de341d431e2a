"""Log-scaled min-max scores and bands by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scalars as S
from zonecast.operators.ordering import with_position

# Weights of the hotspot score.
SCORE_WEIGHTS = {"total": 0.35, "parking": 0.25, "peak": 0.20, "recency": 0.10, "locations": 0.10}


def log_minmax(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Add `norm_<column>`: log1p scaled to 0..1 over the table, or over each group of `by`; 0 where constant.

    The extremes are one row per group and a group is an entity type, of which the caller names a handful: they are
    broadcast, so that a type that holds most entities does not end in one task.
    """
    ends = [f(F.log1p(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    if by is None:
        row = df.agg(F.struct(*ends)).scalar()
        wide = df.withColumn("_ends", row)
    else:
        wide = df.join(F.broadcast(df.groupBy(by).agg(F.struct(*ends).alias("_ends"))), by)

    def low(c: str) -> Column:
        return F.col(f"_ends._lo_{c}")

    def high(c: str) -> Column:
        return F.col(f"_ends._hi_{c}")

    scaled = {
        f"norm_{c}": F.when(high(c) > low(c), (F.log1p(c) - low(c)) / (high(c) - low(c))).otherwise(0.0)
        for c in columns
    }
    return wide.withColumns(scaled).drop("_ends")


def hotspot_score(df: DataFrame, columns: dict[str, str], by: str | None = None) -> DataFrame:
    """Add `hotspot_score` (0..100). `columns` names the column behind each part of SCORE_WEIGHTS."""
    scaled = log_minmax(df, list(columns.values()), by)
    parts = [F.col(f"norm_{columns[p]}") * w for p, w in SCORE_WEIGHTS.items()]
    total = sum(parts[1:], parts[0])
    return scaled.withColumn("hotspot_score", S.round_half_even(total * 100, 2)).drop(
        *[f"norm_{c}" for c in columns.values()]
    )


def band_by_position(
    df: DataFrame, order: list[Column], n_rows: int, name: str = "hotspot_band", cuts=S.BAND_CUTS
) -> DataFrame:
    """Band each row by its place in `order`; the share is position / rows, not a percentile rank."""
    placed = with_position(df, order, "_position")
    return placed.withColumn(name, S.position_band(F.col("_position"), F.lit(n_rows), cuts)).drop("_position")
