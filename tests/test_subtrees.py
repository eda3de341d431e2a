"""Forests that are grown below a small top in tasks and kept as tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonecast.operators import attribution, extra_trees, models, random_forest
from zonecast.operators.subtrees import leaves


def rows_of(spark, n=600):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.uniform(size=n), rng.integers(0, 5, n), rng.uniform(size=n), np.full(n, 3.0)])
    y = np.round(4 * x[:, 0] + (x[:, 1] == 2) * 3, 2)
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "row int, features array<double>, label double")
    return x, y, df.repartition(3)


def forecasts(model, df):
    return {r.row: r.prediction for r in model.transform(df).collect()}


@pytest.mark.parametrize("group", [10_000, 60])
@pytest.mark.parametrize("fit", [extra_trees.fit, random_forest.fit])
def test_tables_and_tops_are_one_forest(spark, fit, group):
    x, y, df = rows_of(spark)
    model = fit(df, numTrees=3, maxDepth=12, seed=5, group=group)
    # the driver holds a node for each group of rows, not one for each row
    held = sum(len(arrays[0]) for arrays, _ in model.tops)
    assert held < 3 * 100 and sum(table.count() for _, table in model.tables) > 3 * 100
    got, trees = forecasts(model, df), model.trees
    want = sum(t[4][leaves(t, x)] for t in trees) / 3
    assert len(got) == len(x) and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in range(len(x)))
    error = np.mean((want - y) ** 2)
    assert error < 0.1 * y.var()
    shares = model.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares[0] > shares[2] and shares[3] == 0
    # other rows than those of the fit, a repeated one and one that lies outside
    other = spark.createDataFrame([(0, [0.5, 2.0, 0.5, 3.0]), (1, [0.5, 2.0, 0.5, 3.0]), (2, [9.0, -1.0, 7.0, 0.0])], "row int, features array<double>")
    xs = np.array([[0.5, 2, 0.5, 3], [0.5, 2, 0.5, 3], [9, -1, 7, 0]])
    assert [v for _, v in sorted(forecasts(model, other).items())] == pytest.approx((sum(t[4][leaves(t, xs)] for t in trees) / 3).tolist())


def test_extra_trees_below_a_top_give_the_rows_back_and_stop_at_the_depth(spark):
    x, y, df = rows_of(spark)
    whole = forecasts(extra_trees.fit(df, numTrees=2, group=50), df)
    assert all(whole[i] == pytest.approx(v, abs=1e-9) for i, v in enumerate(y))
    flat = extra_trees.fit(df, numTrees=2, maxDepth=3, group=200)
    assert max(len(t[0]) for t in flat.trees) <= 15


def test_random_forest_is_as_good_as_sparks(spark):
    x, y, df = rows_of(spark)
    rng = np.random.default_rng(8)
    xs = np.column_stack([rng.uniform(size=300), rng.integers(0, 5, 300), rng.uniform(size=300), np.full(300, 3.0)])
    ys = 4 * xs[:, 0] + (xs[:, 1] == 2) * 3
    held = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(xs)], "row int, features array<double>")
    own = forecasts(random_forest.fit(df, numTrees=8, group=100), held)
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    vector = lambda d: d.withColumn("features", array_to_vector("features"))
    theirs = forecasts(RandomForestRegressor(numTrees=8, maxDepth=30, featureSubsetStrategy="all", seed=1).fit(vector(df)), vector(held))
    error = lambda found: np.mean([(found[i] - v) ** 2 for i, v in enumerate(ys)])
    assert error(own) < 1.5 * error(theirs) + 1e-3


def test_a_tree_splits_where_the_error_falls_most(spark):
    x, y, df = rows_of(spark, 80)
    df = spark.createDataFrame(df.orderBy("row").collect(), df.schema).coalesce(1)  # the order of the rows, and so their draws, are fixed
    model = random_forest.fit(df, numTrees=1, maxDepth=1, seed=2, maxBins=256)
    stump = model.trees[0]
    ids = df.select(F.monotonically_increasing_id().alias("id"), "row").collect()
    w = np.zeros(80)
    for r, drawn in zip(ids, random_forest.draws(2, 0, np.array([r.id for r in ids]))):
        w[r.row] = drawn

    def error(f, cut):
        sides = [x[:, f] <= cut, x[:, f] > cut]
        return sum(np.sum(w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2) for s in sides) if all(w[s].sum() for s in sides) else np.inf

    best = min(error(f, c) for f in range(4) for c in x[:, f])
    assert error(int(stump[0][0]), stump[3][0]) == pytest.approx(best)
    assert stump[4][1] == pytest.approx(np.average(y[x[:, stump[0][0]] <= stump[3][0]], weights=w[x[:, stump[0][0]] <= stump[3][0]]))


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 7.0)], "row int, features array<double>, label double")
    for seed in range(3):  # a tree without a drawn row says the mean
        assert forecasts(random_forest.fit(one, numTrees=4, seed=seed), one) == {0: pytest.approx(7.0)}
    with pytest.raises(ValueError, match="no training rows"):
        random_forest.fit(one.limit(0))


def test_large_forests_are_not_held_by_the_driver(spark, monkeypatch):
    from conftest import SF_DIR
    from zonecast.plans.workspace import workspace

    table = workspace(spark, SF_DIR).training
    train = table.filter("split = 'train'")
    monkeypatch.setattr(models, "DRIVER_NODES", 1_000)
    fitted = models.fit("RandomForest", train, {"numTrees": 3, "maxDepth": 10})
    assert isinstance(fitted.model, random_forest.RandomForestModel)
    preds = fitted.predictions(table)
    assert preds.count() == table.count() and preds.filter("yhat IS NULL OR yhat < 0").count() == 0
    sample = attribution.sample_rows(table, 10)
    parts = attribution.contributions(fitted, sample).groupBy("zone_id", "created_date").agg(F.sum("contribution").alias("t"))
    raw = fitted.model.transform(sample).join(parts, ["zone_id", "created_date"])
    assert raw.count() == 10 and raw.filter("abs(prediction - t) > 1e-9").count() == 0
