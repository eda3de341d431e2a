"""Forests whose trees may have as many nodes as there are training rows.

The top of each tree, down to nodes of a fixed number of rows, is held by the driver and sent to the tasks. What grows below such a node
is grown in a task from the rows of that node alone and kept as a table of nodes, which never passes through the driver. A row is forecast
in the task that holds the subtrees it falls into: rows are spread over (tree, node) and meet the nodes of the subtree there.

Where the rows of a fit were sent to the tasks (`ranks`) the subtrees are whole trees. Rows to forecast that a task can hold are sent to the
tasks that hold the trees, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.operators import ranks
from zonecast.operators.linear import as_array
from zonecast.session import materialize

LEAF = -1
#: Rows times trees that are spread over the tasks at once, which bounds the disk that a fit takes.
BATCH = 10_000_000
#: Of those, what a task takes at most if the groups are even.
TASK_PAIRS = 200_000
#: Tasks of a pass over all rows; each sends its own part of every open node.
PASS_TASKS = 48

NODES = "tree int, node int, local int, feature int, left int, right int, threshold double, value double, gain double, cover double"


class Tree:
    """Node arrays that grow; node 0 is the root."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right = [LEAF], [0.0], [LEAF], [LEAF]
        self.value, self.count, self.gain, self.depth = [0.0], [0], [0.0], [0]

    def split(self, node: int, feature: int, threshold: float, gain: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.gain[node] = feature, threshold, gain
        self.left[node], self.right[node] = len(self.left), len(self.left) + 1
        for column, empty in (
            (self.feature, LEAF), (self.threshold, 0.0), (self.left, LEAF), (self.right, LEAF), (self.value, 0.0), (self.count, 0),
            (self.gain, 0.0), (self.depth, self.depth[node] + 1),
        ):
            column.extend([empty, empty])
        return self.left[node], self.right[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        ints = (np.array(c, dtype=np.int32) for c in (self.feature, self.left, self.right))
        return *ints, np.array(self.threshold), np.array(self.value)


class Nodes:
    """Node columns that grow by many nodes at once; node 0 is the root. The order is that of `NODES` from `feature` on."""

    def __init__(self):
        self.size = 1
        self._columns = [np.full(1, LEAF, np.int32) for _ in range(3)] + [np.zeros(1) for _ in range(4)]

    def split(self, at: np.ndarray, feature: np.ndarray, threshold: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """The left children of the nodes `at`; each right one is the next."""
        left = self.size + 2 * np.arange(len(at))
        self.size += 2 * len(at)
        for i, column in enumerate(self._columns):
            if self.size > len(column):
                self._columns[i] = np.append(column, np.full(self.size, LEAF if i < 3 else 0, column.dtype))
        for i, v in enumerate((feature, left, left + 1, threshold, None, gain)):
            if v is not None:
                self._columns[i][at] = v
        return left

    @property
    def value(self) -> np.ndarray:
        return self._columns[4][: self.size]

    @property
    def count(self) -> np.ndarray:
        return self._columns[6][: self.size]

    def columns(self) -> list[np.ndarray]:
        return [c[: self.size] for c in self._columns]


def leaves(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The node where each row of `x` ends."""
    feature, left, right, threshold, _ = tree
    at = np.zeros(len(x), dtype=np.int32)
    moving = np.flatnonzero(feature[at] != LEAF)
    while len(moving):
        node = at[moving]
        goes_left = x[moving, feature[node]] <= threshold[node]
        at[moving] = np.where(goes_left, left[node], right[node])
        moving = moving[feature[at[moving]] != LEAF]
    return at


def matrix(column, n_features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n_features)


def pass_over(rows: DataFrame) -> DataFrame:
    return rows.coalesce(PASS_TASKS) if rows.rdd.getNumPartitions() > PASS_TASKS else rows


def routed(rows: DataFrame, trees: list[tuple[int, tuple, np.ndarray]], n: int, drawn: Callable | None = None) -> DataFrame:
    """`tree, node` and the columns of `rows` (`id, x`, others), a row for each tree in one of whose `(number, arrays, nodes)` nodes it ends.

    `drawn(tree, ids)` gives the weight of each row in a tree as the column `w`; rows of weight 0 are left out.
    """
    sent = rows.sparkSession.sparkContext.broadcast(trees)
    fields = [T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()), *rows.schema.fields]
    out = T.StructType([*fields, T.StructField("w", T.DoubleType())] if drawn else fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch.column("x"), n), batch.column("id").to_numpy()
            for number, arrays, nodes in sent.value:
                node = leaves(arrays, x)
                inside = np.isin(node, nodes)
                w = drawn(number, ids) if drawn else None
                mine = np.flatnonzero(inside if w is None else inside & (w > 0))
                if not len(mine):
                    continue
                taken = batch.take(pa.array(mine))
                columns = [pa.array(np.full(len(mine), number, np.int32)), pa.array(node[mine]), *taken.columns]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(w[mine])] if drawn else []), names=out.names)

    return rows.mapInArrow(run, out)


def _spread(rows: DataFrame, pairs: int, *order: str) -> DataFrame:
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    return rows.repartition(parts, "tree", "node").sortWithinPartitions("tree", "node", *order)


def _segments(batch) -> Iterator[tuple[int, int, int, int]]:
    """tree, node, from, to of the runs of rows of one node."""
    tree, node = (batch.column(c).to_numpy() for c in ("tree", "node"))
    cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (node[1:] != node[:-1])) + 1
    for s, e in zip(np.append(0, cuts), np.append(cuts, len(tree))):
        yield int(tree[s]), int(node[s]), int(s), int(e)


def node_batch(tree: int, node: int, columns: list[np.ndarray]):
    import pyarrow as pa

    size, names = len(columns[0]), [f.split()[0] for f in NODES.split(", ")]
    ints = [np.full(size, tree, np.int32), np.full(size, node, np.int32), np.arange(size, dtype=np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in [*ints, *columns]], names=names)


#: Whole trees that a task grows, one after the other.
TREES_A_TASK = 2


def whole_trees(spark, n_trees: int, grow: Callable) -> DataFrame:
    """A written table of NODES; `grow(tree)` gives the columns from `local` on, from rows that were sent to the tasks."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                yield node_batch(tree, 0, grow(tree))

    return materialize(spark.range(0, n_trees, 1, -(-n_trees // TREES_A_TASK)).mapInArrow(run, NODES), "trees")


def whole_model(kind: type, nodes: DataFrame, shares: np.ndarray, n_trees: int, **more) -> ForestModel:
    """A model whose trees are all in the table `nodes` from the root on."""
    top, head = (Tree().arrays(), np.array([0], np.int32)), Tree()
    return kind([top] * n_trees, [(list(range(n_trees)), nodes)], shares, [head] * n_trees, True, **more)


def grown(rows: DataFrame, trees: list[tuple[int, tuple, np.ndarray]], n: int, n_rows: int, grow: Callable, drawn: Callable | None = None) -> list[tuple[list[int], DataFrame]]:
    """The subtrees below the nodes of `trees` as written tables of NODES, some trees at a time, with the numbers of those.

    `grow(tree, node, columns)` gives the columns from `local` on for the rows of one node, in the order of their ids.
    """
    trees = [t for t in trees if len(t[2])]
    step, tables = max(1, BATCH // max(1, n_rows)), []
    for at in range(0, len(trees), step):
        some = trees[at : at + step]

        def run(batches: Iterator) -> Iterator:
            def made(key, pieces):
                columns = {c: np.concatenate([p[c] for p in pieces]) for c in pieces[0]}
                return node_batch(*key, grow(*key, columns))

            now, pieces = None, []
            for batch in batches:
                if not batch.num_rows:
                    continue
                names = [c for c in batch.schema.names if c not in ("tree", "node")]
                whole = {c: matrix(batch.column(c), n) if c == "x" else batch.column(c).to_numpy(zero_copy_only=False) for c in names}
                for tree, node, s, e in _segments(batch):
                    if now is not None and (tree, node) != now:
                        yield made(now, pieces)
                        pieces = []
                    now = tree, node
                    pieces.append({c: v[s:e].copy() for c, v in whole.items()})
            if now is not None:
                yield made(now, pieces)

        spread = _spread(routed(rows, some, n, drawn), n_rows * len(some), "id")
        tables.append(([t[0] for t in some], materialize(spread.mapInArrow(run, NODES), "subtrees")))
    return tables


@dataclass(frozen=True)
class ForestModel:
    """Trees as their tops, `(arrays, nodes below which a subtree lies)`, and tables of the subtrees' nodes with the trees in them."""

    tops: list[tuple[tuple[np.ndarray, ...], np.ndarray]]
    tables: list[tuple[list[int], DataFrame]]
    shares: np.ndarray
    heads: list[Tree]
    #: Whether each tree lies in one of the tables from its root on.
    whole: bool = False

    class _Importances:
        def __init__(self, values):
            self._values = values

        def toArray(self):  # noqa: N802 - the name that Spark's models have
            return self._values

    @property
    def featureImportances(self):  # noqa: N802
        """Shares of the error that splits on each input took away."""
        return self._Importances(self.shares)

    @property
    def trees(self) -> list[tuple[np.ndarray, ...]]:
        """Whole trees, for models that are known to be small."""
        out = [[list(a) for a in arrays] for arrays, _ in self.tops]
        for _, table in self.tables:
            for (tree, node), part in table.toPandas().sort_values(["tree", "node", "local"]).groupby(["tree", "node"]):
                into = out[tree]
                base = len(into[0]) - 1  # the subtree's root takes the place of the node
                place = lambda i, base=base, node=node: LEAF if i < 0 else node if i == 0 else base + i
                for r in part.itertuples(index=False):
                    values = r.feature, place(r.left), place(r.right), r.threshold, r.value
                    for column, v in zip(into, values):
                        if r.local:
                            column.append(v)
                        else:
                            column[node] = v
        return [(*(np.array(c, np.int32) for c in t[:3]), *(np.array(c, float) for c in t[3:])) for t in out]

    def nodes(self, spark) -> DataFrame:
        """`tree, node, value, cover, left, right, feature_index, threshold`, the whole trees; a leaf has no `left`."""
        names = ["tree", "node", "value", "cover", "left", "right", "feature_index", "threshold"]
        held = [
            (i, j, float(t.value[j]), float(t.count[j]), t.left[j], t.right[j], t.feature[j], float(t.threshold[j]))
            for i, t in enumerate(self.heads) for j in sorted(set(range(len(t.left))) - set(self.tops[i][1].tolist()))
        ]
        kinds = "tree int, node long, value double, cover double, left long, right long, feature_index int, threshold double"
        out = spark.createDataFrame(held, kinds)
        number = lambda c: F.when(F.col(c) <= 0, F.when(F.col(c) < 0, LEAF).otherwise(F.col("node"))).otherwise(
            (F.col("node").cast("long") + 1) * (1 << 32) + F.col(c)
        ).cast("long")
        for _, table in self.tables:
            whole = table.withColumns({"_node": number("local"), "left": number("left"), "right": number("right"), "feature_index": F.col("feature")})
            out = out.unionByName(whole.drop("node").withColumnRenamed("_node", "node").select(*names))
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """`rows` with `prediction`, the mean over the trees."""
        spark, n, n_trees = rows.sparkSession, len(self.shares), len(self.tops)
        kept = rows.withColumn("x", as_array(rows)).drop("features").withColumn("_row", F.monotonically_increasing_id())
        kept = materialize(kept, "forest_rows")
        if self.whole and ranks.fits_in_task(kept.count(), n):
            return self._of_sent(kept, n).drop("x", "_row")
        asked = kept.select(F.col("_row").alias("id"), "x")
        tops = spark.sparkContext.broadcast([(arrays, nodes) for arrays, nodes in self.tops])

        def closed(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                x, ids = matrix(batch.column("x"), n), batch.column("id").to_numpy()
                for number, (arrays, nodes) in enumerate(tops.value):
                    node = leaves(arrays, x)
                    done = ~np.isin(node, nodes)
                    if done.any():
                        columns = [ids[done], np.full(int(done.sum()), number, np.int32), arrays[4][node[done]]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "tree", "value"])

        def below(batches: Iterator) -> Iterator:
            import pyarrow as pa

            now, pieces, tree_of = None, [], None
            names = ("feature", "left", "right", "threshold", "value")
            for batch in batches:
                if not batch.num_rows:
                    continue
                asks = batch.column("asks").to_numpy(zero_copy_only=False)
                ids, x = batch.column("id"), batch.column("x")
                whole = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
                for tree, node, s, e in _segments(batch):
                    if (tree, node) != now:
                        now, pieces, tree_of = (tree, node), [], None
                    first = s + int(np.searchsorted(asks[s:e], True))  # nodes come before the rows that ask
                    if first > s:
                        pieces.append([c[s:first] for c in whole])
                    if first == e:
                        continue
                    if not pieces:  # no training row was drawn for this tree
                        tree_of = tuple(np.array([v]) for v in (LEAF, LEAF, LEAF, 0.0, tops.value[tree][0][4][node]))
                    elif tree_of is None:
                        columns = [np.concatenate(c) for c in zip(*pieces)]
                        tree_of = tuple(c.astype(np.int32) for c in columns[:3]) + tuple(columns[3:])
                    values = tree_of[4][leaves(tree_of, matrix(x.slice(first, e - first), n))]
                    columns = [ids.slice(first, e - first), pa.array(np.full(e - first, tree, np.int32)), pa.array(values)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "tree", "value"])

        parts, n_rows = [asked.mapInArrow(closed, "id long, tree int, value double")], kept.count()
        for numbers, table in self.tables:
            some = [(i, *self.tops[i]) for i in numbers]
            asking = routed(asked, some, n).select("tree", "node", F.lit(True).alias("asks"), "id", "x")
            nodes = table.select("tree", "node", F.lit(False).alias("asks"), F.col("local").cast("long").alias("id"), "feature", "left", "right", "threshold", "value")
            both = _spread(nodes.unionByName(asking, allowMissingColumns=True), n_rows * len(some), "asks", "id")
            parts.append(both.mapInArrow(below, "id long, tree int, value double"))
        each = reduce(DataFrame.unionByName, parts).groupBy(F.col("id").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("tree", "value"))).alias("v"))
        # added up in the order of the trees, so that no run differs in the last digit
        weights = F.array(*[F.lit(float(w)) for w in self.weights])
        total = F.aggregate("v", F.lit(0.0), lambda s, v: s + v["value"] * F.get(weights, v["tree"]))
        means = each.select("_row", (total / F.lit(float(self.divisor))).alias("prediction"))
        return kept.drop("x").join(means, "_row").drop("_row")

    @property
    def weights(self) -> np.ndarray:
        """What the output of each tree counts in the sum that is divided by `divisor`."""
        return np.ones(len(self.tops))

    @property
    def divisor(self) -> float:
        return float(len(self.tops))

    def _of_sent(self, kept: DataFrame, n: int) -> DataFrame:
        """`kept` (`_row`, `x`) with `prediction`: the rows are sent to the tasks, each of which adds up the outputs of some trees."""
        spark = kept.sparkSession
        if kept.first() is None:
            return kept.withColumn("prediction", F.lit(None).cast("double"))
        weights, step = self.weights, -(-len(self.tops) // PARTS)
        sent = spark.sparkContext.broadcast(ranks.ranked(kept.withColumn("id", F.col("_row")), n, []))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            table = sent.value
            x, now, total = table.matrix(), None, None
            result = lambda: pa.RecordBatch.from_arrays(
                [pa.array(table.ids), pa.array(np.full(len(x), now, np.int32)), pa.array(total)], names=["id", "part", "value"]
            )
            for tree, columns in trees_of(batches):
                if tree // step != now:
                    if now is not None:
                        yield result()
                    now, total = tree // step, np.zeros(len(x))
                arrays = (*columns[:3], columns[3], columns[4])
                total += weights[tree] * columns[4][leaves(arrays, x)]
            if now is not None:
                yield result()

        part = F.floor(F.col("tree") / step).cast("int")
        sums = []
        for numbers, table in self.tables:
            names = ["tree", "node", "local", "feature", "left", "right", "threshold", "value"]
            placed = table.select(*names).repartition(PARTS, part).sortWithinPartitions("tree", "local")
            sums.append(placed.mapInArrow(run, "id long, part int, value double"))
        each = reduce(DataFrame.unionByName, sums).groupBy(F.col("id").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("part", "value"))).alias("v"))
        # the parts are fixed by the number of trees and added up in order, so no run differs in the last digit
        total = F.aggregate("v", F.lit(0.0), lambda s, v: s + v["value"]) / F.lit(float(self.divisor))
        return kept.join(each.select("_row", total.alias("prediction")), "_row")


#: Parts of a whole model whose trees are added up in one task.
PARTS = 16


def trees_of(batches: Iterator) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each tree with its columns from `feature` on, of batches sorted by tree and local."""
    now, pieces = None, []
    whole = lambda: [np.concatenate(c) for c in zip(*pieces)]
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns[3:]]
        for tree, _, s, e in _segments(batch):
            if now is not None and tree != now:
                yield now, whole()
                pieces = []
            now = tree
            pieces.append([c[s:e] for c in columns])
    if now is not None:
        yield now, whole()


def total_gains(nodes: DataFrame, n: int) -> np.ndarray:
    """What splits on each input took off the error in all trees."""
    gains = np.zeros(n)
    for r in nodes.filter(F.col("feature") != LEAF).groupBy("feature").agg(F.sum("gain").alias("g")).collect():
        gains[r.feature] = r.g
    return gains


def gains_of(tables: list[tuple[list[int], DataFrame]], tops: list[Tree], n: int) -> np.ndarray:
    """What splits on each input took off the error, a row for each tree; one number for each tree and input comes back."""
    gains = np.zeros((len(tops), n))
    for i, tree in enumerate(tops):
        for f, g in zip(tree.feature, tree.gain):
            if f != LEAF:
                gains[i, f] += max(g, 0.0)
    for _, table in tables:
        for r in table.filter(F.col("feature") != LEAF).groupBy("tree", "feature").agg(F.sum("gain").alias("g")).collect():
            gains[r.tree, r.feature] += r.g
    return gains
