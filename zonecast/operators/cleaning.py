"""Column clean-up and the features derived from single records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions import scalars as S
from zonecast.operators.ordering import with_position
from zonecast.operators.skew import hot_keys, lookup_join
from zonecast.session import materialize

# Source columns worth keeping; descriptions and closing times are mostly empty.
RAW_COLUMNS = [
    "created_datetime", "violation_type", "vehicle_type", "police_station", "location", "latitude", "longitude"
]


def normalise_columns(df: DataFrame) -> DataFrame:
    """Trim and lower column names and turn runs of blanks into underscores."""
    return df.toDF(*[re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns])


def normalise_key(key: Column) -> Column:
    """Trim and upper-case a non-empty text key."""
    return F.when(key != "", F.upper(F.trim(key))).otherwise(key)


def keep_raw_columns(df: DataFrame, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    return df.select(*columns)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose columns are all null."""
    return df.na.drop(how="all")


def time_parts(df: DataFrame, ts: str, zone: str = "Asia/Kolkata") -> DataFrame:
    """Local date and hour of a UTC timestamp."""
    local = F.from_utc_timestamp(F.col(ts), zone)
    return df.withColumn("created_date", F.to_date(local)).withColumn("created_hour", F.hour(local))


def calendar_flags(
    df: DataFrame, morning: tuple[int, int] = (8, 11), evening: tuple[int, int] = (17, 20)
) -> DataFrame:
    """Weekday, month, weekend and peak columns from `created_date` and `created_hour`."""
    day, hour = F.col("created_date"), F.col("created_hour")
    return df.withColumns(
        {
            "time_bucket": S.time_bucket(hour),
            "is_morning_peak": S.in_hours(hour, *morning),
            "is_evening_peak": S.in_hours(hour, *evening),
            "created_day_of_week": S.weekday_number(day),
            "created_day_name": F.date_format(day, "EEEE"),
            "is_weekend": S.weekend_flag(day),
            "created_month_name": F.date_format(day, "MMMM"),
        }
    ).withColumn("is_peak_hour", F.greatest("is_morning_peak", "is_evening_peak"))


def grid_cell(df: DataFrame, lat: str = "latitude", lon: str = "longitude", decimals: int = 3) -> DataFrame:
    row, col = S.grid_key(F.col(lat), F.col(lon), decimals)
    return df.withColumn("geo_cell", F.concat_ws("_", row, col))


def violation_counts(df: DataFrame, types: str, parking_types: list[str]) -> DataFrame:
    """Parking and other counts and the first entry of an array of violation types."""
    listed = F.col(types)
    parking = F.size(F.filter(listed, lambda t: t.isin(*parking_types)))
    return df.withColumns(
        {
            "parking_related_violation_count": parking,
            "non_parking_violation_count": F.size(listed) - parking,
            "primary_violation": F.get(listed, F.lit(0)),
        }
    )


def days_since_start(df: DataFrame, ts: str) -> DataFrame:
    """Fractional days since the first record."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("days_since_start", (micros - df.agg(F.min(micros)).scalar()) / 86_400_000_000)


def location_load(df: DataFrame, location: str, vehicle: str) -> DataFrame:
    """Attach to each record how many records and how many vehicles its location has."""
    load = df.groupBy(location).agg(
        F.count(F.lit(1)).alias("location_frequency"), F.count(vehicle).alias("vehicle_density")
    )
    return lookup_join(df, load, [location], "left", hot=hot_keys(load, [location], F.col("location_frequency")))


def encode_category(df: DataFrame, column: str) -> DataFrame:
    """Add `<column>_code`: 0 for the most frequent value, equal counts in text order."""
    counts = materialize(df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n")), "codes")
    coded = with_position(counts, [F.desc("_n"), F.asc(column)], f"{column}_code")
    return lookup_join(df, coded.drop("_n"), [column], "left", hot=hot_keys(counts, [column], F.col("_n")))


def with_recency(df: DataFrame, days: str = "days_since_start") -> DataFrame:
    newest = df.agg(F.max(days)).scalar()
    return df.withColumn("recency_weight", S.recency_weight(F.col(days), newest))


def prepare_records(df: DataFrame) -> DataFrame:
    """Calendar columns, grid cell and recency weight on top of the source columns."""
    return with_recency(grid_cell(calendar_flags(df)))
