"""Fits from rows that are sent to the tasks, and the sizes that the registered model queries fit."""

import uuid
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from zonecast.operators import boosting, extra_trees, models, random_forest, ranks, tuning
from zonecast.plans.workspace import Workspace


def rows_of(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.uniform(size=n), rng.integers(0, 5, n), rng.normal(size=n), np.full(n, 3.0)])
    return x, np.round(4 * x[:, 0] + (x[:, 1] == 2) * 3 + x[:, 2] ** 2, 3)


def frame(spark, x, y):
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "row int, x array<double>, label double")
    return df.withColumn("features", array_to_vector("x")).repartition(3)


def table_of(x, y):
    return ranks.Ranked(np.arange(len(y)), *ranks.coded(x), pa.table({"label": y}))


def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_ranks_give_the_rows_back(spark):
    x, y = rows_of()
    sent = ranks.send(frame(spark, x, y), ("row",))
    order = sent.table.kept.column("row").to_numpy()
    assert sorted(order) == list(range(len(y)))
    assert np.array_equal(sent.table.matrix(), x[order]) and np.array_equal(sent.labels(), y[order])
    assert np.allclose(sent.with_log().labels(), np.log1p(y[order]))
    few = sent.table.cuts(256)
    assert np.allclose(few[1], [0.5, 1.5, 2.5, 3.5]) and len(few[3]) == 0
    assert len(sent.table.cuts(16)[0]) == 15
    with pytest.raises(ValueError, match="no training rows"):
        ranks.send(frame(spark, x, y).limit(0))


def test_a_fit_takes_as_many_jobs_whatever_its_trees(spark):
    x, y = rows_of()
    df = frame(spark, x, y)
    for name, few, many in (("LightGBM", {"maxIter": 3}, {"maxIter": 12}), ("ExtraTrees", {"numTrees": 2}, {"numTrees": 9})):
        counts = [jobs_of(spark, lambda p=p: models.fit(name, df, {**p, "maxDepth": 4})) for p in (few, many)]
        assert counts[0] == counts[1] <= 12


@pytest.mark.parametrize("depth,least", [(3, 1), (6, 5)])
def test_boosted_trees_are_sparks(spark, depth, least):
    x, y = rows_of()
    df = frame(spark, x, y)
    params = {"maxIter": 6, "stepSize": 0.2, "maxDepth": depth, "maxBins": 256, "minInstancesPerNode": least}
    own = boosting.fit(ranks.send(df), spark, params)
    theirs = GBTRegressor(labelCol="label", featuresCol="features", seed=1, **params).fit(df)
    a, b = ({r.row: r.prediction for r in m.transform(df).collect()} for m in (own, theirs))
    assert [a[i] for i in range(len(y))] == pytest.approx([b[i] for i in range(len(y))], abs=1e-6)
    assert own.treeWeights == list(theirs.treeWeights)
    # two inputs may part the rows of a node alike, and either may be named
    assert np.allclose(own.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.02)


def plain_tree(x, r, depth, least):
    """The forecast of each row by a tree that tries every cut."""
    best = (1e-9, None)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            goes = x[:, f] <= cut
            if min(goes.sum(), (~goes).sum()) >= least:
                gain = sum(r[s].sum() ** 2 / s.sum() for s in (goes, ~goes)) - r.sum() ** 2 / len(r)
                if gain > best[0] + 1e-6:
                    best = gain, goes
    if depth == 0 or best[1] is None:
        return np.full(len(r), r.mean())
    out = np.empty(len(r))
    for side in (best[1], ~best[1]):
        out[side] = plain_tree(x[side], r[side], depth - 1, least)
    return out


@pytest.mark.parametrize("kept", [boosting.KEPT, 1])
def test_boosting_equals_trying_every_cut(monkeypatch, kept):
    monkeypatch.setattr(boosting, "KEPT", kept)  # 1: counted some nodes at a time at each level
    x, y = rows_of(150)
    want, got = np.zeros(len(y)), None
    for *_, got in boosting.boost(table_of(x, y), y, table_of(x, y), maxIter=4, stepSize=0.3, maxDepth=4, maxBins=256, minInstancesPerNode=3):
        want = plain_tree(x, y, 4, 3) if not want.any() else want + 0.3 * plain_tree(x, 2 * (y - want), 4, 3)
        assert np.allclose(got, want, atol=1e-6)


def test_drawn_rows_and_inputs(spark):
    x, y = rows_of()
    options = {"maxIter": 5, "maxDepth": 3, "maxBins": 64, "subsamplingRate": 0.6, "featureSubsetStrategy": "0.5"}
    a, again, other = ([c for c, *_ in boosting.boost(table_of(x, y), y, **options, seed=s)] for s in (1, 1, 2))
    assert all(np.array_equal(p, q) for c, d in zip(a, again) for p, q in zip(c, d))
    assert any(c[6][0] != d[6][0] or c[0][0] != d[0][0] for c, d in zip(a, other))
    assert all(100 < c[6][0] < 190 for c in a)  # rows of a tree
    same = [c for c, *_ in boosting.boost(table_of(x, np.full(len(y), 2.0)), np.full(len(y), 2.0), maxIter=3, maxDepth=3)]
    assert [len(c[0]) for c in same] == [1, 1, 1]


@pytest.mark.parametrize("fit", [extra_trees.fit, random_forest.fit])
def test_sent_rows_grow_the_trees_of_spread_ones(spark, fit):
    x, y = rows_of()
    df = frame(spark, x, y).select("row", "features", "label").coalesce(1)
    whole, spread = fit(df, numTrees=3, maxDepth=6, seed=5), fit(df, numTrees=3, maxDepth=6, seed=5, group=10_000)
    assert whole.whole and not spread.whole
    a, b = ({r.row: r.prediction for r in m.transform(df).collect()} for m in (whole, spread))
    if fit is extra_trees.fit:
        assert a == pytest.approx(b, abs=1e-9)
    else:  # quantiles of a spread table are near ones
        assert np.mean([(a[i] - b[i]) ** 2 for i in a]) < 0.05 * y.var()
    assert whole.featureImportances.toArray().sum() == pytest.approx(1)


def test_queries_fit_the_published_sizes(monkeypatch):
    fitted = []
    monkeypatch.setattr(models, "training_rows", lambda table: table)
    monkeypatch.setattr(models.ranks, "send", lambda train: None)
    monkeypatch.setattr(models, "fit", lambda name, train, params=None, variant="raw", *sent: fitted.append((name, {**models.PRESETS[name], **(params or {})})))
    Workspace.fits.func(SimpleNamespace(training=None))
    assert len(fitted) == 14 and all(params == models.PRESETS[name] for name, params in fitted)


def test_queries_search_the_published_space(spark, monkeypatch):
    searched = {}

    def halving(blocks, trials, forecast, *_):
        searched[forecast.family] = trials
        return spark.createDataFrame([(0, 100, 3, 0.5)], "trial int, rounds int, folds int, score double")

    x, y = rows_of(60)
    table = frame(spark, x, y).select(
        F.when(F.col("row") < 40, "train").otherwise("val").alias("split"), F.format_string("z%d", F.col("row") % 2).alias("zone_id"),
        F.expr("date_add(DATE '2024-01-01', CAST(row DIV 2 AS INT))").alias("created_date"), F.col("label").alias("y"), "label", "features",
    )
    monkeypatch.setattr(tuning, "halving", halving)
    results, _ = Workspace.tuning.func(SimpleNamespace(training=table))
    assert results.count() == 3 and set(searched) == set(models.TUNED)
    for family, trials in searched.items():
        assert len(trials) == 50 and all(set(t) == set(tuning.SPACES[family]) for t in trials)
        assert all(100 <= t["maxIter"] <= 600 and 3 <= t["maxDepth"] <= 12 for t in trials) and max(t["maxIter"] for t in trials) > 500
