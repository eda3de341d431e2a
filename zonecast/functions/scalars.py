"""Scalar expressions: rounding, dates, names, bands, labels and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published rules for results to agree.
BANDS = ["Very High", "High", "Medium", "Low"]
BAND_CUTS = (0.10, 0.30, 0.60)
RISK_CUTS = (0.90, 0.70, 0.40)
RISK_FLOORS = {"Very High": 90.0, "High": 70.0}
BAND_NUMBER = {"Very High": 4, "High": 3, "Medium": 2, "Low": 1}
BAND_COLOUR = {"Very High": "#ef4444", "High": "#f97316", "Medium": "#eab308", "Low": "#22c55e"}
DEFAULT_COLOUR = "#64748b"
RECENCY_RATE = 0.0231
NO_JUNCTION = "No Junction"
UNNAMED = ("unknown", "no junction")
JUNCTION_CODE = r"^BTP\d+\s*-\s*"
JUNCTION_SUFFIX = r"\s+Junction$"
WIDE_ROAD = r"(?i)(ring\s*road|main\s*road|highway|expressway|junction)"
NARROW_ROAD = r"(?i)(flyover|underpass|bridge|cross)"
PEAK_SEASON = (11, 12, 1)
MONTHS = ["november", "december", "january", "february", "march", "april"]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MANPOWER = {"Very High": 3, "High": 2, "Medium": 1, "Low": 0}
TOW_TRUCKS = {"Very High": 1}
ACTIONS = {
    "Very High": "Deploy Towing Vehicle + 3 Officers + Barricade Support",
    "High": "Deploy 2 Officers + Active Patrol Monitoring",
    "Medium": "Deploy 1 Officer / Mobile Patrol (Warning & Monitoring)",
    "Low": "No Dedicated Deployment",
}
WATCH_WINDOWS = {
    "morning_peak": "08:00 AM - 11:00 AM (Morning Peak Focus)",
    "evening_peak": "05:00 PM - 08:00 PM (Evening Peak Focus)",
    "midday": "11:00 AM - 05:00 PM (Midday Traffic Focus)",
    "night": "08:00 PM - 08:00 AM (Night Monitoring Focus)",
}
DEFAULT_WINDOW = "08:00 AM - 08:00 PM"


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of `table` for `key`, else `default` (null if none is given)."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def round_half_even(x: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.rint(x * scale) / scale


def round_half_up(x: Column) -> Column:
    """Nearest integer with halves going up, for negative numbers too."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def percent_text(share: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)


def recency_weight(days: Column, newest: Column, rate: float = RECENCY_RATE) -> Column:
    """Exponential decay; the default rate halves the weight every 30 days."""
    return F.exp((newest - days) * -rate)


def grid_key(lat: Column, lon: Column, decimals: int = 3) -> tuple[Column, Column]:
    scale = 10.0**decimals
    return F.floor(lat * scale + 0.5), F.floor(lon * scale + 0.5)


def time_bucket(hour: Column) -> Column:
    return (
        F.when(hour.isNull(), None)
        .when((hour >= 8) & (hour < 11), "morning_peak")
        .when((hour >= 11) & (hour < 17), "midday")
        .when((hour >= 17) & (hour < 20), "evening_peak")
        .otherwise("night")
    )


def in_hours(hour: Column, first: int, end: int) -> Column:
    return ((hour >= first) & (hour < end)).cast("int")


def weekday_number(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def weekend_flag(day: Column) -> Column:
    return (F.weekday(day) >= 5).cast("int")


def week_of_month(day: Column) -> Column:
    return (F.floor((F.dayofmonth(day) - 1) / 7) + 1).cast("int")


def peak_season_flag(day: Column, months: tuple[int, ...] = PEAK_SEASON) -> Column:
    return F.month(day).isin(*months).cast("int")


def clean_junction(name: Column) -> Column:
    """Drop the leading police code and the trailing word."""
    return F.regexp_replace(F.regexp_replace(name, JUNCTION_CODE, ""), JUNCTION_SUFFIX, "")


def has_name(name: Column) -> Column:
    """False for null, blank and placeholder names."""
    return F.coalesce((F.trim(name) != "") & ~F.lower(name).isin(*UNNAMED), F.lit(False))


def zone_name(junction: Column, segment: Column, station: Column) -> Column:
    short = clean_junction(junction)
    inside = F.lower(short).contains(F.lower(segment))
    return (
        F.when(junction == NO_JUNCTION, F.concat(segment, F.lit(" / "), station, F.lit(" Zone")))
        .when(inside, F.concat(short, F.lit(" / "), station, F.lit(" Zone")))
        .otherwise(F.concat(segment, F.lit(" / "), short, F.lit(" Zone")))
    )


def _first_band(tests: list[Column]) -> Column:
    chain = reduce(lambda c, t: c.when(t[0], t[1]), list(zip(tests, BANDS))[1:], F.when(tests[0], BANDS[0]))
    return chain.otherwise(BANDS[-1])


def position_band(position: Column, n: Column, cuts=BAND_CUTS) -> Column:
    """Band of the 0-based position in descending score order; the cuts are inclusive."""
    return _first_band([position / n <= c for c in cuts])


def risk_band(percentile: Column, cuts=RISK_CUTS) -> Column:
    return _first_band([percentile >= c for c in cuts])


def threshold_action(score: Column) -> Column:
    """Deployment by score alone: above 90, from 70, from 50, below."""
    return (
        F.when(score > 90, "Deploy towing van + 3 officers")
        .when(score >= 70, "Deploy 2 officers")
        .when(score >= 50, "Patrol monitoring")
        .otherwise("No action needed")
    )


def band_style(band: Column) -> Column:
    return F.regexp_replace(F.lower(band), r"\s+", "-")


def band_colour(band: Column) -> Column:
    return lookup(band, BAND_COLOUR, DEFAULT_COLOUR)


def marker_radius(total: Column) -> Column:
    return clamp(F.sqrt(total) * 0.3, 5.0, 25.0)


def _clock(hour: Column) -> tuple[Column, Column]:
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
    return twelve, F.when(hour < 12, "A").otherwise("P")


def hour_label(hour: Column) -> Column:
    return F.concat(*_clock(hour))


def hour_range(hour: Column) -> Column:
    """One-hour span such as `9:00 AM - 10:00 AM`; both ends carry the half of the day the hour starts in."""
    twelve, half = _clock(hour)
    after = F.when(hour % 12 == 0, 1).otherwise(hour % 12 + 1).cast("string")
    tail = F.concat(F.lit(":00 "), half, F.lit("M"))
    return F.concat(twelve, tail, F.lit(" - "), after, tail)


def heat_class(count: Column, largest: Column) -> Column:
    """0 empty, 1 below a fifth of the largest cell, 2 below three fifths, 3 above."""
    share = count / largest
    return F.when(count <= 0, 0).when(share < 0.2, 1).when(share < 0.6, 2).otherwise(3)


def peak_label(bucket: Column) -> Column:
    return F.when(bucket == "morning_peak", "AM Peak").when(bucket == "evening_peak", "PM Peak").otherwise("Midday")


def road_weight(name: Column) -> Column:
    return F.when(name.rlike(WIDE_ROAD), 100).when(name.rlike(NARROW_ROAD), 80).otherwise(40)


def head_of_name(name: Column) -> Column:
    return F.element_at(F.split(name, " / "), 1)


def short_label(name: Column, length: int = 20) -> Column:
    return F.concat(F.substring(head_of_name(name), 1, length), F.lit("..."))
