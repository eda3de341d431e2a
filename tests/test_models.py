"""Spark ML forecasts on the smallest data set."""

import itertools
import json
import math
import random
import threading
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import SF_DIR
from zonecast.operators import attribution, evaluation, extra_trees, linear, models, tuning
from zonecast.plans.catalog import QUERIES
from zonecast.plans.workspace import workspace


@pytest.fixture(scope="module")
def table(spark):
    return workspace(spark, SF_DIR).training


@pytest.fixture(scope="module")
def boosted(table):
    return models.fit("LightGBM", table.filter("split = 'train'"), {"maxIter": 4, "maxDepth": 3})


def test_unknown_model():
    with pytest.raises(ValueError, match="unknown model: Oracle"):
        models.build_model("Oracle")


def test_every_preset_builds(spark):
    for name in models.PRESETS:
        assert models.build_model(name) is not None
    assert models.build_model("XGBoost", {"maxDepth": 3}).getMaxDepth() == 3


def test_presets_are_the_published_sizes():
    trees = {n: p.get("numTrees", p.get("maxIter")) for n, p in models.PRESETS.items() if n not in models.LINEAR}
    assert trees == {"ExtraTrees": 200, "RandomForest": 200, "HistGradientBoosting": 300, "LightGBM": 300, "XGBoost": 300, "CatBoost": 300}
    assert tuning.N_TRIALS == 50 and all(space["maxIter"][:2] == (100, 600) for space in tuning.SPACES.values())


def test_linear_families_beat_a_constant(table):
    train, held = table.filter("split = 'train'"), table.filter("split <> 'train'")
    mean = train.agg(F.avg("label")).first()[0]
    constant = held.agg(F.avg(F.abs(F.col("y") - mean))).first()[0]
    for name in models.LINEAR:
        preds = models.fit(name, train).predictions(held)
        row = preds.agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"), F.min("yhat").alias("low"), F.count("yhat").alias("n")).first()
        assert row.mae < constant and row.low >= 0 and row.n == held.count()


def test_log_variant_returns_counts(table):
    train, held = table.filter("split = 'train'"), table.filter("split <> 'train'")
    fitted = models.fit("RandomForest", train, {"numTrees": 3, "maxDepth": 4}, "log1p")
    assert fitted.predictions(held).agg(F.max("yhat")).first()[0] <= train.agg(F.max("y")).first()[0] + 1e-9


def test_saved_model_predicts_the_same(spark, table, boosted, tmp_path):
    models.save_model(boosted, str(tmp_path / "m"))
    again = models.load_model(boosted.name, boosted.variant, str(tmp_path / "m"))
    key = ["zone_id", "created_date"]
    a, b = (m.predictions(table).select(*key, F.col("yhat").alias(n)) for m, n in ((boosted, "a"), (again, "b")))
    assert a.join(b, key).filter("abs(a - b) > 1e-12").count() == 0


@pytest.mark.parametrize("family,params", [("LightGBM", {"maxIter": 4, "maxDepth": 3}), ("RandomForest", {"numTrees": 3, "maxDepth": 4})])
def test_contributions_add_up_to_the_output(table, family, params):
    fitted = models.fit(family, table.filter("split = 'train'"), params)
    sample = attribution.sample_rows(table, 40)
    assert sample.count() == 40
    parts = attribution.contributions(fitted, sample)
    total = parts.groupBy("zone_id", "created_date").agg(F.sum("contribution").alias("t"))
    raw = fitted.model.transform(sample).select("zone_id", "created_date", "prediction")
    joined = raw.join(total, ["zone_id", "created_date"])
    assert joined.count() == 40 and joined.filter("abs(prediction - t) > 1e-9").count() == 0
    summary = attribution.mean_attribution(parts, 40)
    assert summary.count() == 33 and summary.filter("mean_abs_contribution < 0").count() == 0


def test_importances(boosted, table):
    forest = models.fit("RandomForest", table.filter("split = 'train'"), {"numTrees": 3, "maxDepth": 4})
    long = models.importances([boosted, forest])
    sums = [r.s for r in long.groupBy("model_name").agg(F.sum("importance").alias("s")).collect()]
    assert sums == pytest.approx([1.0, 1.0])
    wide = models.importance_wide(long, ["LightGBM", "RandomForest"]).collect()
    assert len(wide) == 33 and all(r.average == pytest.approx((r.LightGBM + r.RandomForest) / 2) for r in wide)
    assert models.leading_features(long).count() == 2


def test_parameters_stay_in_range():
    rng = random.Random(1)
    for space in tuning.SPACES.values():
        for _ in range(50):
            drawn = tuning.sample_parameters(space, rng)
            for name, (low, high, kind) in space.items():
                assert low <= float(drawn[name]) <= high
                assert kind != "int" or isinstance(drawn[name], int)


def test_folds(table):
    train = table.filter("split = 'train'")
    by_date = tuning.with_block(train, 3, "date").groupBy("block").agg(
        F.min("created_date").alias("a"), F.max("created_date").alias("b"), F.countDistinct("created_date").alias("n")).orderBy("block").collect()
    assert [r.n for r in by_date] == [25, 22, 22, 22]  # 91 dates, three blocks of 91 // 4
    assert all(x.b < y.a for x, y in zip(by_date, by_date[1:]))
    n = train.count()
    by_row = [r["count"] for r in tuning.with_block(train, 3, "row_order").groupBy("block").count().orderBy("block").collect()]
    assert by_row == [n - 3 * (n // 4), n // 4, n // 4, n // 4]
    with pytest.raises(ValueError):
        tuning.with_block(train, 3, "other")


def test_search_ranks_trials(table):
    space = {"maxIter": (2, 3, "int"), "maxDepth": (2, 3, "int"), "stepSize": (0.1, 0.2, "log")}
    ranked = tuning.search(table, "XGBoost", n_trials=2, n_folds=2, space=space)
    assert len(ranked) == 2 and all(0 <= score <= 1 for *_, score in ranked)


@pytest.mark.parametrize("variant", ["raw", "log1p"])
def test_stages_are_the_forecasts_of_shorter_fits(table, variant):
    train, held = table.filter("split = 'train'"), table.filter("split = 'val'")
    params = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3}
    staged = tuning.staged_forecasts(models.fit("XGBoost", train, params, variant), held, [1, 3, 5])
    for rounds in (1, 3, 5):
        alone = models.fit("XGBoost", train, {**params, "maxIter": rounds}, variant).predictions(held)
        both = alone.select("zone_id", "created_date", F.col("yhat").alias("a")).join(staged.filter(F.col("rounds") == rounds), ["zone_id", "created_date"])
        assert both.count() == held.count() and both.filter("abs(a - yhat) > 1e-9").count() == 0
    assert tuning.stages(600) == list(range(60, 601, 60)) and tuning.stages(3) == [1, 2, 3]


def test_halving_keeps_the_better_half_and_counts_folds(spark):
    rows = [(f"z{z:02d}", d, float((z * 7 + d) % 20), 0 if d < 4 else d // 4) for z in range(12) for d in range(16)]
    blocks = spark.createDataFrame(rows, "zone_id string, created_date int, y double, block int")
    # trial t forecasts t true places of ten
    guess = lambda params, train, held: held.withColumn(
        "yhat", F.when(F.col("zone_id") < f"z{params['t']:02d}", F.col("y")).otherwise(-F.col("y"))
    )
    trials = [{"t": t} for t in range(8)]
    got = tuning.rank_trials(tuning.halving(blocks, trials, guess)).collect()
    folds = sorted((r.folds for r in got), reverse=True)
    assert folds == [3, 3, 2, 2, 1, 1, 1, 1] and sorted(r.place for r in got) == list(range(1, 9))
    whole = {t["t"]: tuning.halving(blocks, [t], guess).first().score for t in trials}
    for r in got:
        assert r.folds < 3 or r.score == pytest.approx(whole[r.trial])


@pytest.mark.parametrize("power,alpha", [(1.0, 0.1), (1.5, 0.1), (1.0, 0.0), (1.5, 3.0)])
def test_linear_fit_equals_a_dense_solution(spark, power, alpha):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(400, 3)), np.full(400, 7.0)])  # the last input never changes
    y = rng.poisson(np.exp(0.3 * x[:, 0] - 0.5 * x[:, 1] + 0.2)).astype(float)
    df = spark.createDataFrame([(r.tolist(), v) for r, v in zip(x, y.tolist())], "features array<double>, label double").repartition(3)
    model = linear.fit(df, power, alpha)
    low, span = x.min(0), np.where(np.ptp(x, 0) > 0, np.ptp(x, 0), 1)
    z = np.column_stack([(x - low) / span, np.ones(len(x))])
    penalty = np.append(np.full(4, alpha), 0)
    w = np.append(np.zeros(4), np.log(y.mean()))
    for _ in range(300):  # Newton steps of a fixed share
        mu = np.exp(z @ w)
        slope = z.T @ ((mu - y) * mu ** (1 - power)) / len(y) + penalty * w
        bend = (z * (mu ** (2 - power))[:, None]).T @ z / len(y) + np.diag(penalty)
        w -= 0.5 * np.linalg.lstsq(bend, slope, rcond=None)[0]
    assert np.allclose([*model.weights, model.intercept], w, atol=1e-6)
    got = [r.prediction for r in model.transform(df).select("features", "prediction").collect()]
    want = {tuple(r): p for r, p in zip(x.tolist(), np.exp(z @ w))}
    assert np.allclose(got, [want[tuple(r.features)] for r in model.transform(df).select("features").collect()], rtol=1e-5)


def test_linear_fit_without_rows_and_without_events(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0.0), ([2.0, 1.0], 0.0)], "features array<double>, label double")
    with pytest.raises(ValueError, match="no training rows"):
        linear.fit(df.limit(0))
    assert all(r.prediction < 1e-6 for r in linear.fit(df).transform(df).collect())


def tree_rows(spark, n=300):
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.uniform(size=n), rng.integers(0, 5, n), rng.uniform(size=n)])
    y = np.round(4 * x[:, 0] + (x[:, 1] == 2) * 3, 3)
    return x, y, spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "features array<double>, label double")


def test_extra_trees(spark):
    x, y, df = tree_rows(spark)
    model = extra_trees.fit(df, numTrees=4, seed=3)
    # all rows in each tree and leaves of one row: the training rows are given back
    out = {tuple(r.features_): r.prediction for r in model.transform(df.withColumn("features_", F.col("features"))).collect()}
    assert all(out[tuple(r)] == pytest.approx(v, abs=1e-9) for r, v in zip(x, y))
    # the same trees from other partitions, others from another seed
    again, other = (extra_trees.fit(df.repartition(5), numTrees=4, seed=s) for s in (3, 4))
    assert all(np.array_equal(a[0], b[0]) and np.allclose(a[3], b[3]) for a, b in zip(model.trees, again.trees))
    assert not np.allclose(model.trees[0][3][0], other.trees[0][3][0])
    # the cut at the root is not the best of all cuts, but lies within the rows
    f, cut = int(model.trees[0][0][0]), float(model.trees[0][3][0])
    error = lambda c: sum(p.var() * len(p) for p in (y[x[:, f] <= c], y[x[:, f] > c]) if len(p))
    assert x[:, f].min() <= cut < x[:, f].max() and error(cut) > min(map(error, x[:, f])) + 1e-9
    shares = model.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares[2] < shares[0]


def test_extra_trees_limits(spark):
    x, y, df = tree_rows(spark)
    stump = extra_trees.fit(df, numTrees=2, maxDepth=1)
    assert all(len(t[0]) == 3 for t in stump.trees)
    wide = extra_trees.fit(df, numTrees=2, minInstancesPerNode=40)
    for t in wide.trees:
        assert min(np.unique(extra_trees.leaves(t, x), return_counts=True)[1]) >= 40
    same = df.withColumn("label", F.lit(2.0))
    assert {r.prediction for r in extra_trees.fit(same, numTrees=2).transform(same).collect()} == {2.0}
    with pytest.raises(ValueError, match="no training rows"):
        extra_trees.fit(df.limit(0))


def by_enumeration(nodes, x, n_features):
    """Shapley values of one row from what the tree expects of every subset of the features."""
    at = {r.node: r for r in nodes.itertuples(index=False)}

    def expected(known, node=0):
        r = at[node]
        if r.left < 0:
            return r.value
        if r.feature_index in known:
            return expected(known, r.left if x[r.feature_index] <= r.threshold else r.right)
        return sum(at[c].cover * expected(known, c) for c in (r.left, r.right)) / r.cover

    out = []
    for f in range(n_features):
        rest, total = [g for g in range(n_features) if g != f], 0.0
        for size in range(n_features):
            for s in itertools.combinations(rest, size):
                weight = math.factorial(size) * math.factorial(n_features - size - 1) / math.factorial(n_features)
                total += weight * (expected({*s, f}) - expected(set(s)))
        out.append(total)
    return expected(set()), out


def test_shapley_values_equal_enumeration(spark):
    rng = np.random.default_rng(2)
    rows, n = [], 4

    def grow(node, depth, cover):
        if depth == 0 or cover < 2:
            rows.append((0, node, float(rng.normal()), float(cover), -1, -1, -1, 0.0))
            return
        part = int(rng.integers(1, cover))
        rows.append((0, node, 0.0, float(cover), 2 * node + 1, 2 * node + 2, int(rng.integers(0, n)), float(rng.uniform())))
        grow(2 * node + 1, depth - 1, part)
        grow(2 * node + 2, depth - 1, cover - part)

    grow(0, 5, 200)
    columns = ["tree", "node", "value", "cover", "left", "right", "feature_index", "threshold"]
    table = pd.DataFrame(rows, columns=columns)
    xs = rng.uniform(size=(12, n))
    data = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(xs)], "row int, x array<double>")
    got = attribution.shapley(spark.createDataFrame(table), data, ["row"], list("abcd"), [2.0]).collect()
    parts = {(r.row, r.feature): r.contribution for r in got}
    for i, x in enumerate(xs):
        base, want = by_enumeration(table, x, n)
        assert parts[i, "(base)"] == pytest.approx(2 * base)
        assert [parts[i, f] for f in "abcd"] == pytest.approx([2 * v for v in want], abs=1e-12)


def test_metrics_take_one_exchange_of_the_forecasts(spark, table):
    preds = models.fit("Poisson Regressor", table.filter("split = 'train'"), {"max_iter": 3}).predictions(table)
    plan = evaluation.metrics_long(preds)._jdf.queryExecution().executedPlan().toString()
    scans, exchanges = plan.count("FileScan"), plan.count("Exchange hashpartitioning")
    # the second exchange carries one partial row a model and split from each task
    assert scans == 1 and exchanges == 2


def made_table(spark):
    """A training table of 12 zones on 24 dates, the last 8 of them held out, four to a split."""
    rows = spark.range(12 * 24).select(
        F.format_string("z%02d", F.col("id") % 12).alias("zone_id"), F.expr("date_add(DATE '2024-01-01', CAST(id DIV 12 AS INT))").alias("created_date"),
        (F.col("id") * 7 % 12 + F.col("id") % 5).cast("double").alias("y"), (F.col("id") * 7 % 12).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"),
    )
    split = F.expr("CASE WHEN created_date < DATE '2024-01-17' THEN 'train' WHEN created_date < DATE '2024-01-21' THEN 'val' ELSE 'test' END")
    return rows.select(split.alias("split"), "zone_id", "created_date", "y", F.col("y").alias("label"), array_to_vector(F.array("a", "b")).alias("features"))


def test_families_are_searched_side_by_side_with_a_bound_on_fits(spark, monkeypatch):
    table, plain_search, plain_fit = made_table(spark), tuning.search, models.fit
    options = {"n_trials": 2, "n_folds": 2, "space": {"maxIter": (2, 3, "int"), "maxDepth": (2, 3, "int"), "stepSize": (0.1, 0.2, "log")}}
    families = ("LightGBM", "XGBoost", "HistGradientBoosting")
    want = {family: plain_search(table, family, **options)[0] for family in families}
    meet, lock, running, most = threading.Barrier(len(families), timeout=60), threading.Lock(), [0], [0]

    def search(*args, **more):
        meet.wait()
        return plain_search(*args, **more)

    def fit(*args):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return plain_fit(*args)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(tuning, "search", search)
    monkeypatch.setattr(models, "fit", fit)
    results, fitted = tuning.tuning_results(table, families, parallelism=2, **options)
    assert most[0] <= 2 and [m.name for m in fitted] == list(families)
    got = {r.model_name: (json.loads(r.best_params), r.best_cv_p10) for r in results.collect()}
    assert got == {family: (params, pytest.approx(score)) for family, (_, params, score) in want.items()}


def test_ensemble_forecasts_each_row_once(spark):
    table = made_table(spark)
    forecast = spark.sparkContext.accumulator(0)

    def guess(y):
        forecast.add(1)
        return y + 1.0

    class Model:
        def __init__(self, name, factor):
            self.name, self.factor = name, factor

        def predictions(self, rows):
            yhat = F.udf(guess, "double")(F.col("y")) * self.factor
            return rows.select(F.lit(self.name).alias("model_name"), F.lit("raw").alias("variant"), "split", "zone_id", "created_date", "y", yhat.alias("yhat"))

    w = SimpleNamespace(training=table, tuning=(None, [Model("One", 1.0), Model("Two", 2.0)]))
    board = QUERIES["ensemble_results"](w).collect()
    assert {r.model_name for r in board} == {"One", "Two", evaluation.SIMPLE_BLEND, evaluation.WEIGHTED_BLEND}
    assert forecast.value == 2 * 12 * 8
