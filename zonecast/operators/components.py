"""Connected components by repeated contraction over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.session import materialize


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label each node (`id`, long) with the smallest id of its component: returns `id, component`.

    `edges(u, v)` holds every edge in both directions. In a round each node hooks to its smallest neighbour if that is
    smaller, hooks are followed to their roots, and the edges are rewritten between roots; edges inside one tree
    vanish. So every round works on a smaller graph, and the trees of all rounds are chained together at the end.

    A contracted node may collect a large share of the edges. Every join reads written tables, so Spark splits such a
    node's partition at run time.
    """
    hooks = []
    n_edges = edges.count()
    while n_edges:
        near = edges.groupBy("u").agg(F.min("v").alias("v"))
        near = materialize(near.select(F.col("u").alias("id"), F.least("u", "v").alias("parent")), "hooks")
        far = _roots(near)
        hooks.append(far)
        for end in ("u", "v"):
            names = far.select(F.col("id").alias(end), F.col("parent").alias("_to"))
            edges = edges.join(names, end).drop(end).withColumnRenamed("_to", end)
        edges = materialize(edges.filter("u <> v").distinct(), "contracted")
        n_edges = edges.count()
    labels = nodes.select("id", F.col("id").alias("component")).limit(0)
    for at, far in enumerate(reversed(hooks)):
        start = far.select("id", F.col("parent").alias("component"))
        labels = materialize(_chain(start, labels), "chained") if at else start
    alone = nodes.select("id").join(labels, "id", "left")
    return materialize(alone.select("id", F.coalesce("component", "id").alias("component")), "components")


def _roots(trees: DataFrame) -> DataFrame:
    """Replace each parent by the root above it, tripling the distance looked ahead in every step."""
    while True:
        step = trees.select(F.col("id").alias("_at"), F.col("parent").alias("_next"))
        second = trees.withColumnRenamed("parent", "_at").join(step, "_at")
        second = second.select("id", F.col("_next").alias("_at"))
        third = second.join(step, "_at")
        trees = materialize(third.select("id", F.col("_next").alias("parent"), (F.col("_at") != F.col("_next")).alias("_moved")), "roots")
        if trees.filter("_moved").isEmpty():
            return trees.drop("_moved")
        trees = trees.drop("_moved")


def _chain(start: DataFrame, later: DataFrame) -> DataFrame:
    """Carry labels through the hooks of the following rounds; nodes that left the graph keep theirs."""
    step = later.select(F.col("id").alias("component"), F.col("component").alias("_next"))
    joined = start.join(step, "component", "left")
    return joined.select("id", F.coalesce("_next", "component").alias("component"))
