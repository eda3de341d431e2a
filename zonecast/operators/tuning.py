"""Random search over tree parameters with successive halving over expanding folds, scored by daily precision at every stage."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from contextvars import copy_context
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.operators import boosting, models, ranks
from zonecast.operators.attribution import tree_nodes
from zonecast.operators.evaluation import daily_precision_at_k, leaderboard
from zonecast.operators.linear import as_array
from zonecast.operators.ordering import with_position
from zonecast.operators.subtrees import ForestModel, leaves
from zonecast.session import materialize

# Published search ranges by family as (low, high, kind), named by the Spark ML parameter each one maps to.
SPACES: dict[str, dict[str, tuple]] = {
    "LightGBM": {
        "maxIter": (100, 600, "int"), "stepSize": (0.01, 0.2, "log"), "maxDepth": (3, 12, "int"),
        "minInstancesPerNode": (5, 50, "int"), "subsamplingRate": (0.5, 1.0, "float"),
        "featureSubsetStrategy": (0.5, 1.0, "share"),
    },
    "XGBoost": {
        "maxIter": (100, 600, "int"), "stepSize": (0.01, 0.2, "log"), "maxDepth": (3, 12, "int"),
        "minInstancesPerNode": (1, 30, "int"), "subsamplingRate": (0.5, 1.0, "float"),
        "featureSubsetStrategy": (0.5, 1.0, "share"),
    },
    "HistGradientBoosting": {
        "maxIter": (100, 600, "int"), "stepSize": (0.01, 0.2, "log"), "maxDepth": (3, 12, "int"),
        "minInstancesPerNode": (5, 50, "int"), "maxBins": (64, 255, "int"),
    },
}
N_TRIALS = 50
#: Share of the trials that goes on from fold to fold.
KEEP = 0.5
#: A boosted model is scored at each of so many equal parts of its rounds.
PARTS = 10


def sample_parameters(space: dict[str, tuple], rng: random.Random) -> dict:
    def draw(low, high, kind):
        if kind == "int":
            return rng.randint(low, high)
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        value = rng.uniform(low, high)
        return f"{value:.4f}" if kind == "share" else value

    return {name: draw(*bounds) for name, bounds in space.items()}


def with_block(train: DataFrame, n_folds: int = 3, mode: str = "date") -> DataFrame:
    """Add `block` 0..n_folds. Fold i trains on the blocks before i and validates on block i.

    `date` cuts the sorted dates, so a fold never sees the future. `row_order` cuts rows in (zone, date) order, which
    is what a plain time-series split of zone-sorted rows does. The first block takes the remainder.
    """
    if mode == "date":
        place = F.row_number().over(Window.orderBy("created_date")) - 1
        n = F.count(F.lit(1)).over(Window.partitionBy())
        dates = train.select("created_date").distinct().withColumn("_at", place).withColumn("_n", n)
        placed = train.join(F.broadcast(dates), "created_date")  # a row per calendar day
    elif mode == "row_order":
        n_rows = train.count()
        order = [F.col("zone_id"), F.col("created_date")]
        placed = with_position(train, order, "_at").withColumn("_n", F.lit(n_rows))
    else:
        raise ValueError(f"unknown fold mode: {mode}")
    if (found := train.select("created_date").distinct().count()) <= n_folds:
        raise ValueError(f"{n_folds} folds need more dates than the {found} there are")
    size = F.floor(F.col("_n") / (n_folds + 1))
    block = F.greatest(F.lit(0), F.floor((F.col("_at") - (F.col("_n") - size * n_folds)) / size) + 1)
    return placed.withColumn("block", F.when(F.col("_at") < F.col("_n") - size * n_folds, 0).otherwise(block)).drop(
        "_at", "_n"
    )


def stages(rounds: int, parts: int = PARTS) -> list[int]:
    """Round counts at which an ensemble of `rounds` trees is scored."""
    return sorted({max(1, rounds * i // parts) for i in range(1, parts + 1)})


def staged_forecasts(fitted: models.Fitted, table: DataFrame, rounds: list[int]) -> DataFrame:
    """Rows of `table` with `rounds` and `yhat` of the ensemble's first trees, for each count in `rounds`, in one pass.

    Spark gives the leaf of each tree for a row; the running sum of the leaves' outputs holds the forecast of every prefix.
    """
    if isinstance(fitted.model, ForestModel):
        return _staged_whole(fitted, table, rounds)
    spark = table.sparkSession
    nodes = tree_nodes(fitted, spark).filter("left < 0").select("tree", "node", "value").toPandas().sort_values(["tree", "node"])
    # leaves count from left to right, and so do node numbers; bounded by the size of the model
    outputs = [g["value"].to_numpy() * w for (_, g), w in zip(nodes.groupby("tree"), fitted.model.treeWeights)]
    sent = spark.sparkContext.broadcast(outputs)
    model = fitted.model.copy()
    model.setLeafCol("leaf")
    kept = [c for c in table.columns if c != "features"]
    rows = model.transform(table).select(*kept, vector_to_array("leaf").alias("leaf"))
    at = np.array(rounds) - 1

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = batch.column("leaf").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(int)
            upto = np.cumsum(np.stack([o[leaf[:, t]] for t, o in enumerate(sent.value)], axis=1), axis=1)[:, at]
            yield _with_upto(batch, kept, upto)

    return _exploded(fitted, rows.mapInArrow(run, _upto_schema(table, kept)), kept, rounds)


def _staged_whole(fitted: models.Fitted, table: DataFrame, rounds: list[int]) -> DataFrame:
    """The same of a boosted model whose trees are a table of nodes; those go to the rows, bounded by the size of the model."""
    trees = [(w, tree) for w, tree in zip(fitted.model.treeWeights, fitted.model.trees)][: max(rounds)]
    sent, at = table.sparkSession.sparkContext.broadcast(trees), np.array(rounds) - 1
    kept = [c for c in table.columns if c != "features"]
    n = len(fitted.model.shares)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)
            upto = np.cumsum(np.stack([w * tree[4][leaves(tree, x)] for w, tree in sent.value], axis=1), axis=1)[:, at]
            yield _with_upto(batch, kept, upto)

    rows = table.select(*kept, as_array(table).alias("x"))
    return _exploded(fitted, rows.mapInArrow(run, _upto_schema(table, kept)), kept, rounds)


def _with_upto(batch: pa.RecordBatch, kept: list[str], upto: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(upto) + 1, dtype=np.int32) * upto.shape[1]), pa.array(upto.ravel()))
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], names=[*kept, "upto"])


def _upto_schema(table: DataFrame, kept: list[str]) -> T.StructType:
    return T.StructType([table.schema[c] for c in kept] + [T.StructField("upto", T.ArrayType(T.DoubleType()))])


def _exploded(fitted: models.Fitted, found: DataFrame, kept: list[str], rounds: list[int]) -> DataFrame:
    counts = F.array(*[F.lit(r) for r in rounds])
    each = found.select(*kept, F.explode(F.arrays_zip(counts.alias("rounds"), F.col("upto").alias("raw"))).alias("e"))
    value = F.expm1("e.raw") if fitted.variant == "log1p" else F.col("e.raw")
    return each.select(*kept, F.col("e.rounds").alias("rounds"), F.greatest(value, F.lit(0.0)).alias("yhat"))


Forecaster = Callable[[dict, DataFrame, DataFrame], DataFrame]


class boosted:  # noqa: N801 - makes a Forecaster
    """Fit once at the drawn number of rounds and forecast with every stage of it.

    Rows that a task can hold are sent to the tasks once for all trials of a fold; a trial is then one task, which forecasts as it fits.
    """

    KEYS = ("zone_id", "created_date", "y")

    def __init__(self, family: str):
        self.family, self._lock, self._of, self._sent = family, Lock(), None, (None, None)

    def __call__(self, params: dict, train: DataFrame, held_out: DataFrame) -> DataFrame:
        rounds = stages(params["maxIter"])
        with self._lock:
            if self._of is not train:
                self._of, self._sent = train, (ranks.send(train), ranks.send(held_out, self.KEYS))
            sent, others = self._sent
        if sent is None or others is None:
            return staged_forecasts(models.fit(self.family, train, params), held_out, rounds)
        keys = ", ".join(f"{c} {held_out.schema[c].dataType.simpleString()}" for c in self.KEYS)
        return boosting.staged(sent, others, train.sparkSession, {"seed": models.SEED, **models.PRESETS[self.family], **params}, rounds, keys)


def halving(
    blocks: DataFrame, trials: list[dict], forecast: Forecaster, n_folds: int = 3, keep: float = KEEP, parallelism: int = 8,
    pool: ThreadPool | None = None,
) -> DataFrame:
    """`trial, rounds, folds, score`: mean precision of each stage of each trial over the folds it was scored on.

    All trials are scored on the first fold; of those on a fold the best share `keep`, by their best stage so far, go on to the next.
    Trials of a fold run as concurrent jobs, `parallelism` at once or in a `pool` shared with other searches, and one aggregate scores all their forecasts. `forecast(params, train, held_out)` gives
    `zone_id, created_date, y, yhat`, and `rounds` if it has stages.
    """
    alive, scores = list(range(len(trials))), None
    for fold in range(1, n_folds + 1):
        train, held_out = blocks.filter(F.col("block") < fold).drop("block"), blocks.filter(F.col("block") == fold).drop("block")

        def run(trial: int, train=train, held_out=held_out, fold=fold) -> DataFrame:
            found = forecast(trials[trial], train, held_out)
            if "rounds" not in found.columns:
                found = found.withColumn("rounds", F.lit(0))
            return materialize(found.select("zone_id", "created_date", "y", "yhat", "rounds", F.lit(trial).alias("trial"), F.lit(fold).alias("fold")), "trial")

        with nullcontext(pool) if pool else ThreadPool(parallelism) as runner:
            parts = runner.map(run, alive)
        scored = materialize(daily_precision_at_k(reduce(DataFrame.unionByName, parts), ["trial", "rounds", "fold"]), "scores")
        scores = scored if scores is None else scores.unionByName(scored)
        if fold < n_folds:
            # a row for each trial that is alive
            means = stage_means(scores.filter(F.col("trial").isin(alive))).groupBy("trial").agg(F.max("score").alias("score")).collect()
            ranked = sorted(means, key=lambda r: (-r.score, r.trial))
            alive = sorted(r.trial for r in ranked[: max(1, math.ceil(len(ranked) * keep))])
    return stage_means(scores)


def stage_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("trial", "rounds").agg(F.count("p10").alias("folds"), (F.round(F.avg("p10") * 1e9) / 1e9).alias("score"))


def rank_trials(results: DataFrame) -> DataFrame:
    """One row a trial with its best stage: more folds first, then the higher score, then fewer rounds, then the earlier trial."""
    best = results.groupBy("trial").agg(F.max(F.struct("folds", "score", (-F.col("rounds")).alias("r"))).alias("b"))
    rows = best.select("trial", (-F.col("b.r")).alias("rounds"), "b.folds", "b.score")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("folds"), F.desc("score"), "trial")))


def search(
    table: DataFrame, family: str, n_trials: int = N_TRIALS, n_folds: int = 3, mode: str = "date",
    space: dict[str, tuple] | None = None, keep: float = KEEP, parallelism: int = 8, pool: ThreadPool | None = None,
) -> list[tuple[str, dict, float]]:
    """Trials `(family, parameters, mean precision)`, best first; `maxIter` is the best stage of the rounds that were drawn."""
    rng = random.Random(models.SEED)
    trials = [sample_parameters(space or SPACES[family], rng) for _ in range(n_trials)]
    blocks = materialize(with_block(models.training_rows(table), n_folds, mode), "blocks")
    ranked = rank_trials(halving(blocks, trials, boosted(family), n_folds, keep, parallelism, pool)).orderBy("place").collect()  # a row a trial
    return [(family, {**trials[r.trial], "maxIter": r.rounds}, r.score) for r in ranked]


def tuning_results(
    table: DataFrame, families: tuple[str, ...] = models.TUNED, parallelism: int = 8, **options
) -> tuple[DataFrame, list[models.Fitted]]:
    """Search each family, fit the best parameters on all training rows, and report both kinds of scores.

    Parameters are stored as JSON text; `sources.marts.parse_parameters` reads them back. The steps of a search wait for each other, so the
    families are searched side by side; at most `parallelism` fits of all of them run at once.
    """
    train, held_out = models.training_rows(table), table.filter("split <> 'train'")
    scope = copy_context()  # tables written in threads belong to the caller's scope
    with ThreadPool(parallelism) as pool, ThreadPool(len(families)) as searches:

        def tune(family: str) -> tuple[tuple, models.Fitted, DataFrame]:
            name, params, score = search(table, family, pool=pool, **options)[0]
            fitted = pool.apply(models.fit, (name, train, params))
            return (name, json.dumps(params), float(score)), fitted, materialize(fitted.predictions(held_out), "tuned")

        best, fits, preds = zip(*searches.map(lambda family: scope.copy().run(tune, family), families))
    facts = table.sparkSession.createDataFrame(list(best), "model_name string, best_params string, best_cv_p10 double")
    return facts.join(leaderboard(reduce(DataFrame.unionByName, preds)).drop("variant"), "model_name"), list(fits)
