"""Random forests of regression trees that the driver need not hold: what Spark's `RandomForestRegressor` grows with every input in every split.

Each tree sees a row as often as a Poisson draw says, from a hash of (seed, tree, row). Inputs are cut at the thresholds of at most `maxBins`
bins, midpoints between values or, where an input has more of them, quantiles. The cut that lowers the squared error most splits a node.
While a node has more than GROUP rows a level takes one pass, in which tasks send counts and sums by bin, combined by Spark, and one row for
each open node reaches the driver; smaller nodes go on in the task that gets their rows (`subtrees`). Rows that a task can hold (`ranks`) are
sent to all tasks instead, and each tree is grown in one of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.operators.extra_trees import uniform
from zonecast.operators.linear import as_array
from zonecast.operators.ranks import Sent, send
from zonecast.operators.subtrees import LEAF, ForestModel, Nodes, Tree, gains_of, grown, leaves, matrix, pass_over, whole_model, whole_trees
from zonecast.session import materialize

#: Rows of a node that a task grows on from; a task holds those of one node, one byte an input.
GROUP = 100_000
#: Nodes whose bins are counted at once in a task.
AT_ONCE = 1_000
#: Shares of the Poisson distribution with mean 1 up to each count.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


class RandomForestModel(ForestModel):
    pass


def draws(seed: int, tree: int, ids: np.ndarray) -> np.ndarray:
    """How often the tree sees each row."""
    return np.searchsorted(_POISSON, uniform(seed + 1_000_003 * tree, np.zeros(len(ids)), ids, 1)[:, 0], side="right").astype(float)


def thresholds(rows: DataFrame, n: int, bins: int) -> list[np.ndarray]:
    """Ascending cuts of each input `x`, fewer than `bins`."""
    at = [F.get("x", F.lit(i)) for i in range(n)]
    # a value above `bins` counted ones means quantiles, whose number the data does not change
    counted = rows.agg(*[F.approx_count_distinct(c, 0.02).alias(f"c{i}") for i, c in enumerate(at)]).first()
    few = [i for i in range(n) if counted[i] <= 2 * bins]
    values = dict(zip(few, rows.agg(*[F.sort_array(F.collect_set(at[i])).alias(f"v{i}") for i in few]).first())) if few else {}
    out = {i: (np.array(v[1:]) + np.array(v[:-1])) / 2 for i, v in values.items() if len(v) <= bins}
    many = [i for i in range(n) if i not in out]
    if many:
        shares = [k / bins for k in range(1, bins)]
        cuts = rows.select(*[at[i].alias(f"x{i}") for i in many]).approxQuantile([f"x{i}" for i in many], shares, 0.001)
        out |= {i: np.unique(c) for i, c in zip(many, cuts)}
    return [out[i] for i in range(n)]


def best_of(counts: np.ndarray, sums: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best input and bin to cut after, and what the cut takes off the error, for arrays (node, input, bin); -inf if no cut does."""
    total_n, total = counts[:, :1].sum(axis=2, keepdims=True), sums[:, :1].sum(axis=2, keepdims=True)
    n_left, s_left = np.cumsum(counts, axis=2)[:, :, :-1], np.cumsum(sums, axis=2)[:, :, :-1]
    n_right = total_n - n_left
    valid = (n_left >= max(least, 1)) & (n_right >= max(least, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(valid, s_left**2 / n_left + (total - s_left) ** 2 / n_right - total**2 / total_n, -np.inf)
    gain = gain.reshape(len(gain), -1)
    top = gain.max(axis=1)
    scale = (total**2 / total_n).reshape(-1)
    # cuts that part the rows alike must tie, and the first one wins
    best = (gain >= (top - 1e-9 * np.abs(np.where(np.isfinite(top), top, 0.0)))[:, None]).argmax(axis=1)
    none = ~(top > 1e-12 * np.maximum(scale, 1e-300))
    return best // n_left.shape[2], best % n_left.shape[2], np.where(none, -np.inf, top)


def _binned(x: np.ndarray, y: np.ndarray, w: np.ndarray, of: np.ndarray, k: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums by (node, input, bin) of rows of the nodes `of`, 0 to k - 1; `x` has a row for each input."""
    n, wy, place = len(x), w * y, of * bins
    counts, sums = np.empty((k, n, bins)), np.empty((k, n, bins))
    for f in range(n):
        cell = place + x[f]
        counts[:, f] = np.bincount(cell, w, k * bins).reshape(k, bins)
        sums[:, f] = np.bincount(cell, wy, k * bins).reshape(k, bins)
    return counts, sums


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: int, bins: int) -> Nodes:
    """The subtree of `depth` levels from the rows of a node, in numbers of bins `x` (input, row)."""
    tree = Nodes()
    at, alive = np.zeros(len(y), np.int64), np.arange(len(y))
    for level in range(depth + 1):
        alive = alive[np.argsort(at[alive], kind="stable")]
        starts = np.flatnonzero(np.diff(at[alive], prepend=-1))
        names, ys, ws = at[alive[starts]], y[alive], w[alive]
        count, total = np.add.reduceat(ws, starts), np.add.reduceat(ws * ys, starts)
        tree.value[names], tree.count[names] = total / count, count
        open_ = (np.minimum.reduceat(ys, starts) < np.maximum.reduceat(ys, starts)) & (count >= 2 * least)
        if level == depth or not open_.any():
            break
        ends = np.append(starts[1:], len(alive))
        going = []
        which = np.flatnonzero(open_)
        for some in np.split(which, range(AT_ONCE, len(which), AT_ONCE)):
            size = ends[some] - starts[some]
            of = np.repeat(np.arange(len(some)), size)
            mine = alive[np.repeat(starts[some] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(len(of))]
            f, b, gain = best_of(*_binned(x[:, mine], y[mine], w[mine], of, len(some), bins), least)
            parted, children = np.isfinite(gain), np.full(len(some), -1)
            children[parted] = tree.split(names[some][parted], f[parted], b[parted], gain[parted])
            at[mine] = np.where(children[of] < 0, -1, children[of] + (x[f[of], mine] > b[of]))
            going.append(mine[at[mine] >= 0])
        alive = np.concatenate(going)
        if not len(alive):
            break
    return tree


def _level(rows: DataFrame, trees: list[tuple], n: int, bins: int, seed: int, least: int):
    """`tree, node, n, s, ymin, ymax, f, b, gain` of the open nodes of `(number, arrays, nodes)`."""
    sent = rows.sparkSession.sparkContext.broadcast(trees)
    cells = [f"{k}{b}" for k in "ns" for b in range(bins)]
    names = ["tree", "node", "f", "m", "ymin", "ymax", *cells]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch.column("x"), n), batch.column("id").to_numpy()
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for number, arrays, nodes in sent.value:
                node, w = leaves(arrays, x), draws(seed, number, ids)
                mine = np.flatnonzero(np.isin(node, nodes) & (w > 0))
                if not len(mine):
                    continue
                of = np.searchsorted(nodes, node[mine])
                k = len(nodes)
                if number not in held:
                    held[number] = [np.zeros((k, n, bins)), np.zeros((k, n, bins)), np.zeros(k), np.full(k, np.inf), np.full(k, -np.inf)]
                into = held[number]
                counts, sums = _binned(x[mine].T, y[mine], w[mine], of, k, bins)
                into[0] += counts
                into[1] += sums
                into[2] += np.bincount(of, minlength=k)
                np.minimum.at(into[3], of, y[mine])
                np.maximum.at(into[4], of, y[mine])
        for number, _, nodes in sent.value:
            if number not in held:
                continue
            counts, sums, m, low, high = held.pop(number)
            for i in np.flatnonzero(m):
                same = [np.full(n, v) for v in (number, int(nodes[i]))]
                columns = [*same, np.arange(n), *(np.full(n, v[i]) for v in (m, low, high)), *counts[i].T, *sums[i].T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def chosen(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            counts, sums = (np.stack([batch.column(f"{k}{b}").to_numpy() for b in range(bins)], axis=1)[:, None] for k in "ns")
            _, b, gain = best_of(counts, sums, least)
            own = [batch.column(c) for c in ("tree", "node", "f", "m", "ymin", "ymax")]
            found = [counts.sum(axis=(1, 2)), sums.sum(axis=(1, 2)), b.astype(np.int64), gain]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in found)], names=["tree", "node", "f", "m", "ymin", "ymax", "n", "s", "b", "gain"])

    kinds = ", ".join(["tree long", "node long", "f long", "m double", "ymin double", "ymax double", *(f"{c} double" for c in cells)])
    parts = pass_over(rows).mapInArrow(run, kinds).groupBy("tree", "node", "f").agg(
        F.sum("m").alias("m"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"), *[F.sum(c).alias(c) for c in cells]
    )
    each = parts.mapInArrow(chosen, "tree long, node long, f long, m double, ymin double, ymax double, n double, s double, b long, gain double")
    best = each.groupBy("tree", "node").agg(
        *[F.max(c).alias(c) for c in ("m", "ymin", "ymax", "n")], F.max_by("s", -F.col("f")).alias("s"),
        F.max(F.struct(F.col("gain"), (-F.col("f")).alias("minus_f"), (-F.col("b")).alias("minus_b"))).alias("best"),
    )
    return best.orderBy("tree", "node").collect()  # a row for each open node


def cut_at(cuts: list[np.ndarray], feature: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The cut behind each bin, 0 for leaves."""
    first = np.append(0, np.cumsum([len(c) for c in cuts]))[:-1]
    split = feature != LEAF
    out = np.zeros(len(feature))
    out[split] = np.concatenate(cuts)[first[feature[split]] + after[split].astype(int)]
    return out


def with_cuts(columns: list[np.ndarray], cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Node columns with cuts in place of bins."""
    return [*columns[:3], cut_at(cuts, columns[0], columns[3]), *columns[4:]]


def shares_of(gains: np.ndarray) -> np.ndarray:
    """The mean share of each input over the trees, from a row of gains for each tree."""
    each = gains.sum(axis=1, keepdims=True)
    shares = np.divide(gains, each, out=np.zeros_like(gains), where=each > 0).sum(axis=0)
    return shares / shares.sum() if shares.sum() else shares


def _fit_sent(spark, sent: Sent, n_trees: int, depth: int, bins: int, least: int, seed: int) -> RandomForestModel:
    rows, log, cuts = sent.rows, sent.log, sent.table.cuts(bins)

    def one(number: int) -> list[np.ndarray]:
        table = rows.value
        y, w = np.log1p(table.label) if log else table.label, draws(seed, number, table.ids)
        if not w.any():  # what a tree says that no row is drawn for
            leaf = Nodes()
            leaf.value[0] = y.mean()
            return leaf.columns()
        mine = np.flatnonzero(w)
        return with_cuts(grow(table.binned(cuts)[:, mine], y[mine], w[mine], depth, least, bins).columns(), cuts)

    nodes = whole_trees(spark, n_trees, one)
    model = whole_model(RandomForestModel, nodes, np.zeros(sent.n), n_trees)
    return whole_model(RandomForestModel, nodes, shares_of(gains_of(model.tables, model.heads, sent.n)), n_trees)


def fit(
    train: DataFrame, numTrees: int = 200, maxDepth: int = 30, maxBins: int = 32, minInstancesPerNode: int = 1, seed: int = 42,  # noqa: N803 - Spark's names
    featureSubsetStrategy: str = "all", group: int | None = None, sent: Sent | None = None,  # noqa: N803
) -> RandomForestModel:
    """Fit `label` on `features` (an array or a vector), every input in every split. Without rows: ValueError.

    `sent` are the same rows if they have been sent before. With `group` given, a task grows from no more rows than that.
    """
    if featureSubsetStrategy != "all" or maxBins > 256:
        raise ValueError("a forest splits on all features, in at most 256 bins")
    sent = sent or (send(train) if group is None else None)
    if sent is not None:
        return _fit_sent(train.sparkSession, sent, numTrees, maxDepth, maxBins, minInstancesPerNode, seed)
    group = group or GROUP
    given = train.select(F.monotonically_increasing_id().alias("id"), as_array(train).alias("x"), F.col("label").cast("double").alias("label"))
    given = materialize(given, "tree_rows")
    first = given.first()
    if first is None:
        raise ValueError("no training rows")
    n = len(first.x)
    cuts = thresholds(given, n, maxBins)

    def to_bins(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), n)
            found = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(n)], axis=1).astype(np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, batch.column("label")], names=["id", "x", "label"])

    rows = materialize(given.mapInArrow(to_bins, "id long, x array<smallint>, label double"), "binned")
    n_rows = rows.count()
    trees, growing = [Tree() for _ in range(numTrees)], {i: [0] for i in range(numTrees)}
    below = {i: [] for i in range(numTrees)}
    if n_rows <= group:
        below, growing = growing, {}
        mean = rows.agg(F.avg("label")).first()[0]
        for tree in trees:  # what a tree says that no row is drawn for
            tree.value[0] = mean
    for depth in range(maxDepth + 1):
        sent = [(i, trees[i].arrays(), np.array(nodes)) for i, nodes in growing.items() if nodes]
        if not sent:
            break
        growing = {}
        for r in _level(rows, sent, n, maxBins, seed, minInstancesPerNode):
            tree = trees[r.tree]
            tree.value[r.node], tree.count[r.node] = r.s / r.n, int(r.n)
            if depth == maxDepth or r.ymin == r.ymax or r.best.gain == -math.inf:
                continue
            if r.m <= group:
                below[r.tree].append(r.node)
            else:
                growing.setdefault(r.tree, []).extend(tree.split(r.node, -r.best.minus_f, float(-r.best.minus_b), r.best.gain))

    depths = {(t, node): trees[t].depth[node] for t, nodes in below.items() for node in nodes}

    def subtree(number, node, columns):
        x = np.ascontiguousarray(columns["x"].T)
        tree = grow(x, columns["label"], columns["w"], maxDepth - depths[number, node], minInstancesPerNode, maxBins)
        return with_cuts(tree.columns(), cuts)

    in_bins = [(i, t.arrays(), np.array(below[i], np.int32)) for i, t in enumerate(trees)]
    tables = grown(rows, in_bins, n, n_rows, subtree, lambda tree, ids: draws(seed, tree, ids))
    shares = shares_of(gains_of(tables, trees, n))
    tops = [((a[0], a[1], a[2], cut_at(cuts, a[0], a[3]), a[4]), nodes) for _, a, nodes in in_bins]
    for tree, (arrays, _) in zip(trees, tops):
        tree.threshold = arrays[3].tolist()
    return RandomForestModel(tops, tables, shares, trees)
