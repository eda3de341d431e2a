"""Weighted DBSCAN on the sphere, exact, without comparing all pairs of a crowded place.

Points are deduplicated and put on a grid whose cells have a diagonal below eps. A cell with weight >= min_samples is
*dense*: all its points are core and belong together, so the whole cell is one node. Any other cell holds fewer than
min_samples points, each of them a node of its own. Nodes are compared through the bounding boxes of their points; only
where a box is neither surely inside nor surely outside eps do points get compared, and two crowded cells are then split
into quarters until boxes decide. The work is linear in the number of distinct points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.functions.geo import BOX, CellGrid, box_bounds, box_columns, haversin_of, haversine_m, usable_coordinate
from zonecast.operators.components import connected_components
from zonecast.operators.ordering import with_position
from zonecast.operators.skew import lookup_join
from zonecast.session import materialize

_SURE = 1e-9  # relative slack within which a box bound is not trusted and points are compared
_DIRECT_PAIRS = 64  # boxes with at most this many point pairs are compared point by point
_MAX_DEPTH = 40  # quarters of a cell are then below the resolution of a double
# Label tables up to this many rows (some 40 bytes each) are broadcast to the records; larger ones are joined by shuffle.


def split_usable(records: DataFrame, lat: str = "latitude", lon: str = "longitude") -> tuple[DataFrame, DataFrame]:
    """Rows with usable coordinates, and the quarantined rest."""
    ok = usable_coordinate(F.col(lat), F.col(lon))
    return records.filter(ok), records.filter(~ok)


def distinct_points(records: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One row per coordinate with the number of records there."""
    usable, _ = split_usable(records, lat, lon)
    return usable.groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.count(F.lit(1)).alias("weight"))


@dataclass(frozen=True)
class Clustering:
    """Result of `dbscan`.

    `nodes` has a row per dense cell and per point outside dense cells, with `weight`, `core` and `component`, the id
    of the smallest core node in (lat, lon) order; `component_lat, component_lon` name it. Noise has a null component.
    """

    grid: CellGrid
    points: DataFrame
    nodes: DataFrame
    n_points: int
    n_nodes: int

    def point_labels(self) -> DataFrame:
        """`lat, lon, weight, component_lat, component_lon, is_core` for each distinct coordinate."""
        label = ["component_lat", "component_lon"]
        loose = self.nodes.filter("NOT dense").select("lat", "lon", "weight", *label, F.col("core").alias("is_core"))
        cells = self.nodes.filter("dense").select("row", "col", *label, F.col("core").alias("is_core"))
        inside = lookup_join(self.points, cells, ["row", "col"], "inner")
        return inside.select(*loose.columns).unionByName(loose)

    def label_records(self, records: DataFrame, labels: DataFrame, lat: str = "latitude", lon: str = "longitude"):
        """Left join `labels` (one row per `component`) to the records by their place.

        Records find their label by cell, or by point outside dense cells. Labels and nodes are written tables, so Spark
        broadcasts them by their true size or else joins and splits skewed partitions.
        """
        new = [c for c in labels.columns if c != "component"]
        named = lookup_join(self.nodes.filter("component IS NOT NULL"), labels, ["component"], "inner")
        row = self.grid.row(F.col(lat))
        placed = records.withColumn("_row", row).withColumn("_col", self.grid.col(F.col("_row"), F.col(lon)))
        cells = named.filter("dense").select(
            F.col("row").alias("_row"), F.col("col").alias("_col"), *[F.col(c).alias(f"_cell_{c}") for c in new]
        )
        loose = named.filter("NOT dense").select(
            F.col("lat").alias(lat), F.col("lon").alias(lon), *[F.col(c).alias(f"_point_{c}") for c in new]
        )
        joined = placed.join(cells, ["_row", "_col"], "left")
        joined = joined.join(loose, [lat, lon], "left")
        picked = [F.coalesce(f"_cell_{c}", f"_point_{c}").alias(c) for c in new]
        return joined.select(*records.columns, *picked)


def dbscan(
    records: DataFrame, lat: str = "latitude", lon: str = "longitude", eps_m: float = 100.0, min_samples: int = 10,
    direct_pairs: int = _DIRECT_PAIRS,
) -> Clustering:
    """Cluster the distinct coordinates of `records`, each weighted by its number of records."""
    grid = CellGrid(eps_m)
    points = materialize(
        distinct_points(records, lat, lon)
        .withColumn("row", grid.row(F.col("lat")))
        .withColumn("col", grid.col(F.col("row"), F.col("lon"))),
        "points",
    )
    n_points = points.count()
    nodes, n_nodes = _nodes(points, min_samples)
    pairs = materialize(_node_pairs(nodes, grid), "pairs")
    members = _members(points, pairs, nodes, n_points)

    reached = materialize(_reached(pairs, members, eps_m, n_points), "reached")
    support = reached.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("_support"))
    is_core = F.col("dense") | (F.coalesce("_support", F.lit(0)) >= min_samples)
    nodes = materialize(nodes.join(support, "id", "left").withColumn("core", is_core).drop("_support"), "nodes")
    core = nodes.filter("core").select("id")

    loose = (
        reached.filter("u <> v").select("u", "v", "v_dense")
        .join(core.withColumnRenamed("id", "u"), "u", "left_semi")
        .join(core.withColumnRenamed("id", "v"), "v", "left_semi")
    )
    singles = loose.filter("NOT v_dense").select("u", "v")  # these come in both directions already
    loose = loose.filter("v_dense").select("u", "v")
    crowded = pairs.filter("u_dense AND v_dense")
    unsure = crowded.filter("NOT inside").select("u", "v", (F.col("u_n") * F.col("v_n")).alias("_pairs"))
    few = unsure.filter(F.col("_pairs") <= direct_pairs).select("u", "v")
    small = members.filter(F.col("n") <= direct_pairs).select("id", "lat", "lon")
    near = _touching(few, small, ["u"], small, ["v"], eps_m, n_points)
    links = loose.unionByName(crowded.filter("inside").select("u", "v")).unionByName(near)
    edges = materialize(_both_ways(links).unionByName(singles), "edges")
    labels = connected_components(core, edges)

    # crowded pairs still undecided matter only if nothing else has joined the two cells
    rest = (
        unsure.filter(F.col("_pairs") > direct_pairs)
        .join(labels.select(F.col("id").alias("u"), F.col("component").alias("_cu")), "u")
        .join(labels.select(F.col("id").alias("v"), F.col("component").alias("_cv")), "v")
        .filter("_cu <> _cv")
        .select("u", "v")
    )
    rest = materialize(rest, "undecided")
    if not rest.isEmpty():
        labels = _merge(labels, _refined_links(rest, members, grid, direct_pairs, n_points), n_nodes)

    # a border point takes the lowest label among the core nodes that reach it
    border = (
        reached.join(nodes.filter("NOT core").select(F.col("id").alias("u")), "u", "left_semi")
        .join(labels.withColumnRenamed("id", "v"), "v")
        .groupBy(F.col("u").alias("id"))
        .agg(F.min("component").alias("component"))
    )
    names = nodes.select(
        F.col("id").alias("component"), F.col("lat").alias("component_lat"), F.col("lon").alias("component_lon")
    )
    named = lookup_join(labels.unionByName(border), names, ["component"], "inner")
    return Clustering(grid, points, materialize(nodes.join(named, "id", "left"), "clustered"), n_points, n_nodes)


def _nodes(points: DataFrame, min_samples: int) -> tuple[DataFrame, int]:
    """Dense cells and the single points of all other cells, numbered in (lat, lon) order of their first point."""
    cells = materialize(
        points.groupBy("row", "col").agg(
            F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"),
            F.min("lat").alias("lat_lo"), F.max("lat").alias("lat_hi"),
            F.min("lon").alias("lon_lo"), F.max("lon").alias("lon_hi"),
            F.min(F.struct("lat", "lon")).alias("first"),
        ),
        "cells",
    )
    dense = cells.filter(F.col("weight") >= min_samples).select(
        "row", "col", F.lit(True).alias("dense"), "weight", "n", F.col("first.lat").alias("lat"),
        F.col("first.lon").alias("lon"), *box_columns(*[F.col(c) for c in ("lat_lo", "lat_hi", "lon_lo", "lon_hi")]),
    )
    # fewer than min_samples points per cell: the cell list is the small, evenly spread side
    open_cells = cells.filter(F.col("weight") < min_samples).select("row", "col")
    single = points.join(open_cells, ["row", "col"], "left_semi").select(
        "row", "col", F.lit(False).alias("dense"), "weight", F.lit(1).cast("long").alias("n"), "lat", "lon",
        *box_columns(F.col("lat"), F.col("lat"), F.col("lon"), F.col("lon")),
    )
    size = F.sum(F.when(F.col("weight") >= min_samples, 1).otherwise(F.col("n")))
    n_nodes = cells.agg(size).first()[0] or 0
    found = with_position(dense.unionByName(single), [F.col("lat"), F.col("lon")], "id")
    return materialize(found, "numbered"), n_nodes


def _box(prefix: str) -> dict[str, Column]:
    return {part: F.col(f"{prefix}_{part}") for part in BOX}


def _node_pairs(nodes: DataFrame, grid: CellGrid) -> DataFrame:
    """Pairs of nodes that may touch: (single, any) in both directions, itself included, and (dense, dense) once."""
    fields = ["dense", "n", "weight", "lat", "lon", *BOX]
    left = nodes.select("row", "col", F.col("id").alias("u"), *[F.col(c).alias(f"u_{c}") for c in fields])
    right = nodes.select("row", "col", F.col("id").alias("v"), *[F.col(c).alias(f"v_{c}") for c in fields])
    pairs = grid.explode_neighbours(left).join(right, ["row", "col"])
    pairs = pairs.filter(~F.col("u_dense") | (F.col("v_dense") & (F.col("u") < F.col("v"))))
    low, high = box_bounds(_box("u"), _box("v"))
    limit = haversin_of(grid.eps_m)
    singles = ~F.col("u_dense") & ~F.col("v_dense")
    inside = F.when(singles, True).otherwise(high * (1 + _SURE) <= limit)
    slack = F.when(singles, 1.0).otherwise(1 - _SURE)
    return pairs.filter(low * slack <= limit).select(
        "u", "v", "u_dense", "v_dense", "u_n", "v_n", "v_weight", "u_lat", "u_lon", inside.alias("inside")
    )


def _members(points: DataFrame, pairs: DataFrame, nodes: DataFrame, n_points: int) -> DataFrame:
    """Points of the dense cells that some undecided pair needs, with the id and the size of their cell."""
    undecided = pairs.filter("NOT inside")
    wanted = undecided.select(F.col("v").alias("id")).unionByName(
        undecided.filter("u_dense").select(F.col("u").alias("id"))
    ).distinct()
    cells = nodes.filter("dense").join(wanted, "id", "left_semi").select("row", "col", "id", "n")
    return materialize(lookup_join(points, cells, ["row", "col"], "inner"), "members")


def _reached(pairs: DataFrame, members: DataFrame, eps_m: float, n_points: int) -> DataFrame:
    """`u, v, v_dense, w`: weight of node v that lies within eps of the single point u."""
    single = pairs.filter("NOT u_dense")
    whole = single.filter("inside").select("u", "v", "v_dense", F.col("v_weight").alias("w"))
    part = single.filter("NOT inside").select("u", F.col("v").alias("id"), "u_lat", "u_lon")
    near = haversine_m(F.col("u_lat"), F.col("u_lon"), F.col("lat"), F.col("lon")) <= eps_m
    counted = (
        lookup_join(members.select("id", "lat", "lon", "weight"), part, ["id"], "inner")
        .filter(near)
        .groupBy("u", F.col("id").alias("v"))
        .agg(F.sum("weight").alias("w"))
        .withColumn("v_dense", F.lit(True))
    )
    return whole.unionByName(counted)


def _touching(
    pairs: DataFrame, left: DataFrame, u: list[str], right: DataFrame, v: list[str], eps_m: float, n_points: int
) -> DataFrame:
    """Pairs `u, v` of which some point of `left` and some point of `right` are within eps.

    The first columns of `left` and `right` are matched to the pair columns `u` and `v`; the last two are lat, lon.
    """
    a = left.select(*[F.col(c).alias(k) for c, k in zip(left.columns, u)],
                    F.col("lat").alias("_alat"), F.col("lon").alias("_alon"))
    b = right.select(*[F.col(c).alias(k) for c, k in zip(right.columns, v)],
                     F.col("lat").alias("_blat"), F.col("lon").alias("_blon"))
    with_a = lookup_join(a, pairs, u, "inner")
    with_b = lookup_join(b, with_a, v, "inner")
    near = haversine_m(F.col("_alat"), F.col("_alon"), F.col("_blat"), F.col("_blon")) <= eps_m
    return with_b.filter(near).select("u", "v").distinct()


def _merge(labels: DataFrame, links: DataFrame, n_nodes: int) -> DataFrame:
    """Labels after joining the components that `links` connect. Only the components are clustered again."""
    of_u = labels.select(F.col("id").alias("u"), F.col("component").alias("_cu"))
    of_v = labels.select(F.col("id").alias("v"), F.col("component").alias("_cv"))
    between = links.join(of_u, "u").join(of_v, "v").select(F.col("_cu").alias("u"), F.col("_cv").alias("v"))
    between = materialize(_both_ways(between).distinct(), "component_edges")
    ends = between.select(F.col("u").alias("id")).distinct()
    joined = connected_components(ends, between)
    new = joined.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    moved = lookup_join(labels, new, ["component"], "left")
    return materialize(moved.select("id", F.coalesce("_to", "component").alias("component")), "merged")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _refined_links(
    pairs: DataFrame, members: DataFrame, grid: CellGrid, direct_pairs: int, n_points: int
) -> DataFrame:
    """Decide which pairs of crowded cells touch, by quartering both cells until boxes of points decide.

    Each level keeps only box pairs that are neither surely inside nor surely outside eps, and drops a pair of cells as
    soon as one link between them is known. Boxes with few points left are compared point by point.
    """
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    involved = materialize(members.join(ids, "id", "left_semi"), "involved")
    down = F.col("lat") / grid.height - F.col("row")
    across = F.col("lon") / grid.width(F.col("row")) - F.col("col")
    limit = haversin_of(grid.eps_m)
    zero = F.lit(0).cast("long")
    todo = pairs.select("u", "v", *[zero.alias(c) for c in ("u_i", "u_j", "v_i", "v_j")])
    found = []
    for level in range(1, _MAX_DEPTH + 1):
        parts = float(2**level)
        placed = involved.select(
            "id", F.floor(down * parts).alias("i"), F.floor(across * parts).alias("j"), "lat", "lon"
        )
        boxes = materialize(
            placed.groupBy("id", "i", "j").agg(
                F.count(F.lit(1)).alias("n"), *box_columns(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon"))
            ),
            "boxes",
        )
        for side in ("u", "v"):
            quarter = boxes.select(
                F.col("id").alias(side), F.shiftright("i", 1).alias(f"{side}_i"), F.shiftright("j", 1).alias(f"{side}_j"),
                *[F.col(c).alias(f"{side}_{c}_") for c in ("i", "j")],
                *[F.col(c).alias(f"{side}_{c}") for c in ("n", *BOX)],
            )
            todo = todo.join(quarter, [side, f"{side}_i", f"{side}_j"]).drop(f"{side}_i", f"{side}_j")
            todo = todo.withColumnsRenamed({f"{side}_i_": f"{side}_i", f"{side}_j_": f"{side}_j"})
        low, high = box_bounds(_box("u"), _box("v"))
        todo = todo.withColumn("_inside", high * (1 + _SURE) <= limit).filter(low * (1 - _SURE) <= limit)
        keys = ["u", "v", "u_i", "u_j", "v_i", "v_j"]
        todo = materialize(todo.select(*keys, (F.col("u_n") * F.col("v_n")).alias("_pairs"), "_inside"), "quarters")
        sure = todo.filter("_inside").select("u", "v").distinct()
        last = F.lit(level == _MAX_DEPTH)
        few = todo.filter(~F.col("_inside") & ((F.col("_pairs") <= direct_pairs) | last)).select(*keys)
        close = _touching(few, placed, ["u", "u_i", "u_j"], placed, ["v", "v_i", "v_j"], grid.eps_m, n_points)
        found.append(materialize(sure.unionByName(close).distinct(), "links"))
        todo = todo.filter(~F.col("_inside") & (F.col("_pairs") > direct_pairs) & ~last).select(*keys)
        todo = materialize(todo.join(found[-1], ["u", "v"], "left_anti"), "quarters_left")
        if todo.isEmpty():
            break
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()
