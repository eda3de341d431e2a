"""Connected components of a graph whose edges are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.session import materialize


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """`node, component` for every node of `edges(u, v)` (longs): the smallest node of its component.

    Alternates two steps on written tables until nothing changes: every node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones. Both keep components as they are, halve the depth, and end in stars around the smallest
    node. A node's neighbours are combined by `min` before the shuffle and joined back, so no task holds a node's whole list
    and a node with very many neighbours is split like any skewed join key.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # stars around the smallest nodes have one edge a node, and no node is both a leaf and a centre
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
