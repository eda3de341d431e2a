"""Exact Shapley values of tree ensembles.

What a tree expects of a row when only a subset S of the features is known follows the splits on known features and takes both sides of
the others in proportion to the training rows (`cover`). A leaf is then a game of its own: each feature on its path gives a factor, 1 or
0 as the row meets the conditions if the feature is known and the share of the cover if not. The value of a feature sums over all subsets,
which the coefficients of a product of linear factors do at once, grouped by size. Rows stay where they are and the node table, which
is as large as the model, goes to the tasks; work is rows x leaves x the square of the features on a path.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.operators.models import SEED, Fitted
from zonecast.operators.panel import FEATURES
from zonecast.operators.subtrees import ForestModel
from zonecast.session import materialize, scratch_root


def tree_nodes(fitted: Fitted, spark) -> DataFrame:
    """`tree, node, value, cover, left, right, feature_index, threshold` of a forest or boosted model; a leaf has no `left`."""
    if isinstance(fitted.model, ForestModel):
        return fitted.model.nodes(spark)
    path = f"{scratch_root(spark)}/trees-{uuid.uuid4().hex}"
    fitted.model.write().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["prediction"].alias("value"),
        n["rawCount"].cast("double").alias("cover"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature_index"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    )


def tree_weights(fitted: Fitted) -> list[float]:
    if isinstance(fitted.model, ForestModel):
        return [float(w) / fitted.model.divisor for w in fitted.model.weights]
    weights = [float(w) for w in fitted.model.treeWeights]
    forest = "RandomForest" in type(fitted.model).__name__
    return [w / len(weights) for w in weights] if forest else weights


def sample_rows(table: DataFrame, n: int = 500, seed: int = SEED) -> DataFrame:
    """`n` rows in an order that depends only on the row key and the seed, not on the partitioning."""
    return table.orderBy(F.xxhash64("zone_id", "created_date", F.lit(seed)), "zone_id", "created_date").limit(n)


def paths(nodes: pd.DataFrame) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Each leaf of a tree: its value and, for the features on its path, (above, up to, share of the cover that goes this way)."""
    at = {int(r.node): r for r in nodes.itertuples(index=False)}
    stack: list[tuple[int, dict]] = [(int(nodes["node"].min()), {})]
    while stack:
        node, known = stack.pop()
        r = at[node]
        if r.left < 0:
            yield r.value, known
            continue
        low, high, share = known.get(r.feature_index, (-np.inf, np.inf, 1.0))
        for child, bounds in ((r.left, (low, min(high, r.threshold))), (r.right, (max(low, r.threshold), high))):
            part = at[child].cover / r.cover if r.cover else 0.5
            stack.append((child, {**known, r.feature_index: (*bounds, share * part)}))


def leaf_values(value: float, known: dict[int, tuple[float, float, float]], x: np.ndarray, out: np.ndarray) -> float:
    """Add the Shapley values of one leaf for each row of `x` to `out`; returns what the leaf adds to the expectation."""
    features = list(known)
    zero = np.array([known[f][2] for f in features])
    m = len(features)
    if m:
        one = np.stack([(x[:, f] > known[f][0]) & (x[:, f] <= known[f][1]) for f in features]).astype(float)
        # k known features among the m - 1 others stand for k! (m - 1 - k)! / m! of the orders
        orders = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
        for i, f in enumerate(features):
            sizes = np.zeros((m, len(x)))
            sizes[0] = 1.0
            for j in range(m):
                if j != i:
                    sizes[1:] = sizes[1:] * zero[j] + sizes[:-1] * one[j]
                    sizes[0] *= zero[j]
            out[:, f] += value * (one[i] - zero[i]) * (orders @ sizes)
    return value * zero.prod()


def shapley(nodes: DataFrame, rows: DataFrame, key: list[str], names: list[str], weights: list[float] | None = None) -> DataFrame:
    """`key..., feature, contribution` with a row `(base)` for each input row; they add up to the output of the model.

    `nodes` is a node table as of `tree_nodes`, `rows` has the array `x` of the features `names`. Trees without a weight have weight 1.
    """
    spark, base = nodes.sparkSession, "(base)"
    table = nodes.toPandas()  # as large as the model
    weigh = dict(enumerate(weights or []))
    leaves = [
        (value * weigh.get(int(tree), 1.0), known) for tree, part in table.groupby("tree") for value, known in paths(part)
    ]
    sent = spark.sparkContext.broadcast(leaves)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(names))
                out = np.zeros((len(x), len(names) + 1))
                out[:, -1] = sum(leaf_values(value, known, x, out) for value, known in sent.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in key], lists], names=[*key, "v"])

    schema = T.StructType([rows.schema[c] for c in key] + [T.StructField("v", T.ArrayType(T.DoubleType()))])
    labels = F.array(*[F.lit(n) for n in [*names, base]])
    each = rows.select(*key, "x").mapInArrow(run, schema).select(*key, F.explode(F.arrays_zip(labels.alias("feature"), F.col("v"))).alias("e"))
    return each.select(*key, F.col("e.feature").alias("feature"), F.col("e.v").alias("contribution"))


def contributions(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """`zone_id, created_date, feature, contribution` and a row with feature `(base)` per input row."""
    nodes = materialize(tree_nodes(fitted, rows.sparkSession), "tree_nodes")
    sample = rows.select("zone_id", "created_date", vector_to_array("features").alias("x"))
    return shapley(nodes, sample, ["zone_id", "created_date"], FEATURES, tree_weights(fitted))


def mean_attribution(parts: DataFrame, n_rows: int) -> DataFrame:
    """Mean absolute contribution per feature over the sample, features that never split included as 0."""
    spark = parts.sparkSession
    listed = spark.createDataFrame([(f,) for f in FEATURES], "feature string")
    sums = parts.filter("feature <> '(base)'").groupBy("feature").agg(F.sum(F.abs("contribution")).alias("s"))
    return listed.join(sums, "feature", "left").select(
        "feature", (F.coalesce("s", F.lit(0.0)) / n_rows).alias("mean_abs_contribution")
    ).orderBy(F.desc("mean_abs_contribution"), "feature")
