"""Extremely randomised regression trees, all trees grown level by level over the distributed rows.

In each open node every input gets one cut point, uniform between the least and the largest value that the rows of the node have, and the
input whose cut lowers the squared error most splits the node. While a node has more than GROUP rows, a level takes two passes: ranges of
the open nodes, then counts and sums left of their cuts; tasks send one row for each open node, combined by Spark. Smaller nodes go on in
the task that gets their rows (`subtrees`), by the same rules. So the driver holds some nodes for each GROUP rows of a tree. Rows that a task
can hold (`ranks`) are sent to all tasks instead, and each tree is grown in one of them.

Cut points come from a hash of (seed, tree, node, input), so they depend on neither partitioning nor order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.operators.linear import as_array
from zonecast.operators.ranks import Sent, coded, send
from zonecast.operators.subtrees import ForestModel, Nodes, Tree, gains_of, grown, leaves, matrix, pass_over, total_gains, whole_model, whole_trees
from zonecast.session import materialize

#: Rows of a node that a task grows on from; a task holds those of one node.
GROUP = 100_000
#: More than the nodes that a group can have, to number the cut points of subtrees.
_ROOM = 1 << 17


class ExtraTreesModel(ForestModel):
    pass


def uniform(seed: int, tree: np.ndarray, node: np.ndarray, n_features: int) -> np.ndarray:
    """A number in [0, 1) for each node and input, from a 64-bit mixing hash."""
    with np.errstate(over="ignore"):
        h = (np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) ^ (tree.astype(np.uint64) << np.uint64(40)) ^ node.astype(np.uint64)
        h = h[:, None] * np.uint64(0xBF58476D1CE4E5B9) + np.arange(1, n_features + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
        for shift in (30, 27, 31):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)) / float(1 << 53)


def _node_rows(rows: DataFrame, trees: list[tuple], n_features: int, work, columns: list[str], combine: dict) -> dict[str, np.ndarray]:
    """`work(x, y, tree, node)` of each open node's rows in a task, combined over tasks; one row a node comes back.

    `trees`: (number, arrays, open nodes) of the trees that still grow.
    """
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column("x"), n_features), batch.column("label").to_numpy(zero_copy_only=False)
            for number, arrays, growing in sent.value:
                node = leaves(arrays, x)
                mine = np.flatnonzero(np.isin(node, growing))
                if not len(mine):
                    continue
                mine = mine[np.argsort(node[mine], kind="stable")]
                names, starts = np.unique(node[mine], return_index=True)
                found = work(x[mine], y[mine], starts, number, names, node[mine])
                data = [np.full(len(names), number), names.astype(np.int64), *found]
                yield pa.RecordBatch.from_arrays([pa.array(d) for d in data], names=["tree", "node", *columns])

    types = ", ".join(["tree long", "node long", *(f"{c} double" for c in columns)])
    found = pass_over(rows).mapInArrow(run, types).groupBy("tree", "node").agg(*[combine[c.rstrip("0123456789")](c).alias(c) for c in columns])
    got = found.toPandas().sort_values(["tree", "node"])
    return {c: got[c].to_numpy() for c in ["tree", "node", *columns]}


def ranges_of(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    add = np.add.reduceat
    low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    return [add(np.ones(len(y)), starts), add(y, starts), np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts), *low.T, *high.T]


def left_of(x: np.ndarray, y: np.ndarray, starts: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """Counts and sums left of the cuts; `cut` has a row for each row of `x`."""
    goes = x <= cut
    return [*np.add.reduceat(goes.astype(float), starts).T, *np.add.reduceat(goes * y[:, None], starts).T]


def cuts_of(low: np.ndarray, high: np.ndarray, share: np.ndarray) -> np.ndarray:
    cuts = low + share * (high - low)
    return np.where(cuts >= high, low, cuts)  # rounding must not put all rows on one side


def best_of(count, total, n_left, s_left, low, high, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The input that splits each node and what that takes off the error; -inf if none can."""
    count, total = count[:, None], total[:, None]
    n_right = count - n_left
    valid = (low < high) & (n_left >= least) & (n_right >= least) & (n_left > 0) & (n_right > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(valid, s_left**2 / n_left + (total - s_left) ** 2 / n_right - total**2 / count, -np.inf)
    # sums come in any order; cuts that part the rows alike must tie, and the first input wins
    top = np.where(np.isfinite(gain.max(axis=1)), gain.max(axis=1), 0.0)[:, None]
    best = (gain >= top - 1e-9 * np.abs(top) - 1e-12).argmax(axis=1)
    return best, gain[np.arange(len(best)), best]


def grow(codes: np.ndarray, values: list[np.ndarray], y: np.ndarray, number: int, root: int, depth: int, least: int, seed: int) -> Nodes:
    """The subtree of `depth` levels below the node `root` of tree `number`, from the node's rows as `ranks.Ranked` has them."""
    tree, n, add = Nodes(), len(values), np.add.reduceat
    at, alive = np.zeros(len(y), np.int64), np.arange(len(y))
    for level in range(depth + 1):
        alive = alive[np.argsort(at[alive], kind="stable")]
        starts = np.flatnonzero(np.diff(at[alive], prepend=-1))
        names, ys = at[alive[starts]], y[alive]
        count, total = np.diff(np.append(starts, len(alive))), add(ys, starts)
        tree.value[names], tree.count[names] = total / count, count
        open_ = (np.minimum.reduceat(ys, starts) < np.maximum.reduceat(ys, starts)) & (count >= 2 * least)
        if level == depth or not open_.any():
            break
        of = np.repeat(np.arange(len(names)), count)
        stays = open_[of]
        alive, ys, of = alive[stays], ys[stays], (np.cumsum(open_) - 1)[of[stays]]
        names, count, total = names[open_], count[open_], total[open_]
        starts = np.append(0, np.cumsum(count)[:-1])
        share = uniform(seed, np.full(len(names), number), root * _ROOM + names, n)
        low, high, cuts, n_left, s_left = (np.empty((len(names), n)) for _ in range(5))
        upto = np.empty((len(names), n), np.int64)
        for f, v in enumerate(values):
            c = codes[f][alive]
            low[:, f], high[:, f] = v[np.minimum.reduceat(c, starts)], v[np.maximum.reduceat(c, starts)]
            cuts[:, f] = cuts_of(low[:, f], high[:, f], share[:, f])
            upto[:, f] = np.searchsorted(v, cuts[:, f], side="right") - 1
            goes = c <= upto[:, f].astype(codes.dtype)[of]
            n_left[:, f], s_left[:, f] = add(goes, starts, dtype=np.int64), add(goes * ys, starts)
        best, gain = best_of(count.astype(float), total, n_left, s_left, low, high, least)
        parted, at_best = np.isfinite(gain), (np.arange(len(names)), best)
        children = np.full(len(names), -1)
        children[parted] = tree.split(names[parted], best[parted], cuts[at_best][parted], gain[parted])
        right = codes[best[of], alive] > upto[at_best][of]
        at[alive] = np.where(children[of] < 0, -1, children[of] + right)
        alive = alive[at[alive] >= 0]
        if not len(alive):
            break
    return tree


def _fit_sent(spark, sent: Sent, n_trees: int, depth: int, least: int, seed: int) -> ExtraTreesModel:
    rows, log = sent.rows, sent.log

    def one(number: int) -> list[np.ndarray]:
        table = rows.value
        y = np.log1p(table.label) if log else table.label
        return grow(table.codes, table.values, y, number, 0, depth, least, seed).columns()

    nodes = whole_trees(spark, n_trees, one)
    gains = total_gains(nodes, sent.n)
    return whole_model(ExtraTreesModel, nodes, gains / gains.sum() if gains.sum() else gains, n_trees)


def fit(
    train: DataFrame, numTrees: int = 200, maxDepth: int = 30, minInstancesPerNode: int = 1, seed: int = 42, group: int | None = None,  # noqa: N803 - Spark's names
    sent: Sent | None = None,
) -> ExtraTreesModel:
    """Fit `label` on `features` (an array or a vector) with all rows in each tree. Without rows: ValueError.

    `sent` are the same rows if they have been sent before. With `group` given, a task grows from no more rows than that.
    """
    sent = sent or (send(train) if group is None else None)
    if sent is not None:
        return _fit_sent(train.sparkSession, sent, numTrees, maxDepth, minInstancesPerNode, seed)
    group = group or GROUP
    rows = train.select(F.monotonically_increasing_id().alias("id"), as_array(train).alias("x"), F.col("label").cast("double").alias("label"))
    rows = materialize(rows, "tree_rows")
    first = rows.first()
    if first is None:
        raise ValueError("no training rows")
    n, n_rows = len(first.x), rows.count()
    features = range(n)
    trees, growing = [Tree() for _ in range(numTrees)], {i: [0] for i in range(numTrees)}
    below = {i: [] for i in range(numTrees)}
    if n_rows <= group:
        below, growing = growing, {}

    def ranges(x, y, starts, number, names, node):
        return ranges_of(x, y, starts)

    combine = {"n": F.sum, "s": F.sum, "ymin": F.min, "ymax": F.max, "lo": F.min, "hi": F.max, "nl": F.sum, "sl": F.sum}
    for depth in range(maxDepth + 1):
        sent = [(i, trees[i].arrays(), np.array(nodes)) for i, nodes in growing.items() if nodes]
        if not sent:
            break
        got = _node_rows(rows, sent, n, ranges, ["n", "s", "ymin", "ymax", *[f"lo{f}" for f in features], *[f"hi{f}" for f in features]], combine)
        for tree, node, count, total in zip(got["tree"], got["node"], got["n"], got["s"]):
            trees[tree].value[node], trees[tree].count[node] = total / count, int(count)
        low, high = (np.stack([got[f"{k}{f}"] for f in features], axis=1) for k in ("lo", "hi"))
        open_ = (got["ymin"] < got["ymax"]) & (got["n"] >= 2 * minInstancesPerNode) & (low < high).any(axis=1)
        if depth < maxDepth:
            small = open_ & (got["n"] <= group)
            for tree, node in zip(got["tree"][small].tolist(), got["node"][small].tolist()):
                below[tree].append(node)
            open_ &= ~small
        if depth == maxDepth or not open_.any():
            break
        tree, node, low, high = got["tree"][open_], got["node"][open_], low[open_], high[open_]
        cuts = cuts_of(low, high, uniform(seed, tree, node, n))
        by_tree = {t: (node[tree == t], cuts[tree == t]) for t in np.unique(tree)}

        def left_of_cuts(x, y, starts, number, names, node, by_tree=by_tree):
            known, cut = by_tree[number]
            return left_of(x, y, starts, cut[np.searchsorted(known, node)])

        sent = [(t, trees[t].arrays(), nodes) for t, (nodes, _) in by_tree.items()]
        left = _node_rows(rows, sent, n, left_of_cuts, [*[f"nl{f}" for f in features], *[f"sl{f}" for f in features]], combine)
        n_left, s_left = (np.stack([left[f"{k}{f}"] for f in features], axis=1) for k in ("nl", "sl"))
        best, gain = best_of(got["n"][open_], got["s"][open_], n_left, s_left, low, high, minInstancesPerNode)
        growing = {}
        for i, f in enumerate(best):
            if np.isfinite(gain[i]):
                growing.setdefault(int(tree[i]), []).extend(trees[tree[i]].split(int(node[i]), int(f), float(cuts[i, f]), float(gain[i])))

    depths = {(t, node): trees[t].depth[node] for t, nodes in below.items() for node in nodes}

    def subtree(number, node, columns):
        return grow(*coded(columns["x"]), columns["label"], number, node, maxDepth - depths[number, node], minInstancesPerNode, seed).columns()

    tops = [(t.arrays(), np.array(below[i], np.int32)) for i, t in enumerate(trees)]
    tables = grown(rows, [(i, *top) for i, top in enumerate(tops)], n, n_rows, subtree)
    gains = gains_of(tables, trees, n).sum(axis=0)
    return ExtraTreesModel(tops, tables, gains / gains.sum() if gains.sum() else gains, trees)
