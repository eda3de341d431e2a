"""Spherical distance and the cell grid used for radius joins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def _haversin(radians: Column) -> Column:
    s = F.sin(radians / 2)
    return s * s


def _arc_m(a: Column) -> Column:
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_RADIUS_M)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between two points given in degrees."""
    return _arc_m(
        _haversin(F.radians(lat2 - lat1))
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * _haversin(F.radians(lon2 - lon1))
    )


def metres_to_radians(metres: float) -> float:
    return metres / EARTH_RADIUS_M


def usable_coordinate(lat: Column, lon: Column) -> Column:
    """True where both coordinates are present, not NaN and on the globe."""
    # NaN sorts above every number, so the upper limits reject it
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))


def haversin_of(metres: float) -> float:
    """Squared half-chord of a distance: comparing these needs no square root and no arc function."""
    return math.sin(metres_to_radians(metres) / 2) ** 2


BOX = ["south", "north", "west", "east", "cos_least", "cos_most"]


def box_columns(lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column) -> list[Column]:
    """A box of points in radians with the range of the cosine of its latitudes, worked out once per box."""
    south, north = F.radians(lat_lo), F.radians(lat_hi)
    most = F.when((lat_lo <= 0) & (lat_hi >= 0), 1.0).otherwise(F.greatest(F.cos(south), F.cos(north)))
    values = [south, north, F.radians(lon_lo), F.radians(lon_hi), F.least(F.cos(south), F.cos(north)), most]
    return [value.alias(name) for value, name in zip(values, BOX)]


def box_bounds(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """Lower and upper bound of the squared half-chord between any point of box `a` and any point of box `b`.

    Both bounds are the exact value when the boxes are single points. Longitudes are compared on the circle.
    """
    lat_gap = F.greatest(F.lit(0.0), a["south"] - b["north"], b["south"] - a["north"])
    lat_span = F.greatest(a["north"] - b["south"], b["north"] - a["south"])
    halves = (a["east"] - a["west"] + b["east"] - b["west"]) / 2
    apart = F.abs((a["west"] + a["east"] - b["west"] - b["east"]) / 2)
    apart = F.least(apart, 2 * math.pi - apart)
    lon_gap = F.greatest(F.lit(0.0), apart - halves)
    lon_span = F.least(F.lit(math.pi), apart + halves)
    low = _haversin(lat_gap) + a["cos_least"] * b["cos_least"] * _haversin(lon_gap)
    high = _haversin(lat_span) + a["cos_most"] * b["cos_most"] * _haversin(lon_span)
    return low, high


@dataclass(frozen=True)
class CellGrid:
    """Grid whose cells have a diagonal just below `eps_m`: two points of one cell are always within eps.

    Rows are latitude bands of equal height. The column width of a band follows its own latitude, so cells keep their
    size in metres from the equator to the poles. Cells that can hold a point within eps lie at most two rows away.
    """

    eps_m: float

    @property
    def height(self) -> float:
        shrink = 1 - 1e-6 - metres_to_radians(self.eps_m) ** 2 / 10
        return math.degrees(metres_to_radians(self.eps_m)) / math.sqrt(2) * shrink

    def _nearest_latitude(self, row: Column) -> Column:
        low, high = row * self.height, (row + 1) * self.height
        return F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))

    def _farthest_latitude(self, row: Column) -> Column:
        return F.least(F.lit(90.0), F.greatest(F.abs(row * self.height), F.abs((row + 1) * self.height)))

    def width(self, row: Column) -> Column:
        return F.lit(self.height) / F.greatest(F.cos(F.radians(self._nearest_latitude(row))), F.lit(1e-9))

    def row(self, lat: Column) -> Column:
        return F.floor(lat / self.height)

    def col(self, row: Column, lon: Column) -> Column:
        return F.floor(lon / self.width(row))

    def explode_neighbours(self, df: DataFrame) -> DataFrame:
        """Replace each row's cell `(row, col)` by every cell that may hold a point within eps, the cell itself included.

        Columns west of -180 or east of 180 degrees continue on the other side. `turn` picks the side, and its columns
        leave out those the unturned range already has, so no cell is named twice even around a pole.
        """
        far = F.greatest(self._farthest_latitude(F.col("row")), self._farthest_latitude(F.col("_r")))
        sine = math.sin(metres_to_radians(self.eps_m) / 2) / F.greatest(F.cos(F.radians(far)), F.lit(1e-12))
        reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), sine))) * (1 + 1e-6)
        out = (
            df.withColumn("_west", F.col("col") * self.width(F.col("row")))
            .withColumn("_east", (F.col("col") + 1) * self.width(F.col("row")))
            .withColumn("_r", F.explode(F.sequence(F.col("row") - 2, F.col("row") + 2)))
            .withColumn("_reach", reach)
            .withColumn("_width", self.width(F.col("_r")))
        )

        def column(lon: Column) -> Column:
            return F.floor(lon / F.col("_width"))

        first, last = column(F.col("_west") - F.col("_reach")), column(F.col("_east") + F.col("_reach"))
        ring_first, ring_last = column(F.lit(-180.0)), column(F.lit(180.0))
        crosses = (first < ring_first) | (last > ring_last)
        turn = F.explode(F.when(crosses, F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))).otherwise(F.array(F.lit(0.0))))
        out = out.withColumn("_turn", turn)
        turned_first = column(F.col("_west") + F.col("_turn") - F.col("_reach"))
        turned_last = column(F.col("_east") + F.col("_turn") + F.col("_reach"))
        start = F.greatest(turned_first, ring_first, F.when(F.col("_turn") > 0, last + 1))
        stop = F.least(turned_last, ring_last, F.when(F.col("_turn") < 0, first - 1))
        return (
            out.withColumn("_first", start).withColumn("_last", stop).filter("_first <= _last")
            .withColumn("col", F.explode(F.sequence("_first", "_last")))
            .withColumn("row", F.col("_r"))
            .drop("_west", "_east", "_r", "_reach", "_width", "_turn", "_first", "_last")
        )
