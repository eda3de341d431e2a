"""Forecast models on Spark ML: families, fitting, long forecasts, leaderboard and importances."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.operators import boosting, extra_trees, linear, random_forest, ranks
from zonecast.operators.evaluation import baseline_predictions, leaderboard
from zonecast.operators.panel import FEATURES, TARGET
from zonecast.operators.subtrees import ForestModel
from zonecast.session import materialize

SEED = 42
LINEAR = ("Poisson Regressor", "Tweedie (p=1.5)")

# Model families with the published settings, in terms of Spark ML. Boosters that grow leaf by leaf are
# given the depth that holds as many leaves; Spark's trees stop at depth 30.
PRESETS: dict[str, dict] = {
    "Poisson Regressor": {"power": 1.0, "alpha": 0.1, "max_iter": 500},
    "Tweedie (p=1.5)": {"power": 1.5, "alpha": 0.1, "max_iter": 500},
    "ExtraTrees": {"numTrees": 200, "maxDepth": 30},
    "RandomForest": {"numTrees": 200, "maxDepth": 30, "featureSubsetStrategy": "all"},
    "HistGradientBoosting": {"maxIter": 300, "stepSize": 0.1, "maxDepth": 5, "maxBins": 255, "minInstancesPerNode": 20},
    "LightGBM": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "maxBins": 255, "minInstancesPerNode": 20},
    "XGBoost": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 7, "maxBins": 256},
    "CatBoost": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 7, "maxBins": 254},
}
TUNED = ("LightGBM", "XGBoost", "HistGradientBoosting")


@dataclass(frozen=True)
class Own:
    """A family that this library fits itself: `fit` has the shape of a Spark estimator's."""

    train: Callable
    params: dict

    def fit(self, rows: DataFrame, **more):
        return self.train(rows, **self.params, **more)


def build_model(name: str, params: dict | None = None) -> Estimator | Own:
    """Estimator of a family; `params` override the preset. Unknown names raise ValueError."""
    if name not in PRESETS:
        raise ValueError(f"unknown model: {name}")
    chosen = {**PRESETS[name], **(params or {})}
    if name in LINEAR:
        return Own(linear.fit, chosen)
    if name == "ExtraTrees":
        return Own(extra_trees.fit, {"seed": SEED, **chosen})
    if name == "RandomForest":
        return Own(forest, {"seed": SEED, **chosen})
    return GBTRegressor(seed=SEED, labelCol="label", featuresCol="features", **chosen)


#: Most nodes of a forest that the driver holds; Spark's own forests are held there.
DRIVER_NODES = 200_000


def forest(rows: DataFrame, sent: ranks.Sent | None = None, **params) -> Model | ForestModel:
    """Spark's random forest where its nodes are few for certain, or else one whose trees are grown and kept in tasks."""
    most = min(2 * rows.count(), 2 ** (params["maxDepth"] + 1))
    if params["numTrees"] * most > DRIVER_NODES:
        return random_forest.fit(rows, sent=sent, **params)
    return RandomForestRegressor(labelCol="label", featuresCol="features", **params).fit(rows)


def assemble(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Feature vector next to the `keep` columns. A row with full history has no null, so nulls are an error."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="error").transform(rows)
    return vectors.select(*keep, "features")


#: Rows that a task of a fit takes. A fit is thousands of small jobs one after the other, each as slow as its number of tasks.
TASK_ROWS = 20_000


def training_table(split_rows: DataFrame) -> DataFrame:
    """`split, zone_id, created_date, y, label, features`, written once for all fits and forecasts."""
    labelled = split_rows.withColumn("y", F.col(TARGET).cast("double")).withColumn("label", F.col("y"))
    return materialize(assemble(labelled, ["split", "zone_id", "created_date", "y", "label"]), "training")


def training_rows(table: DataFrame) -> DataFrame:
    """The rows of a `training_table` that fits learn from, in as many parts as the rows of the table need."""
    return table.coalesce(max(1, -(-table.count() // TASK_ROWS))).filter("split = 'train'")


@dataclass(frozen=True)
class Fitted:
    name: str
    variant: str
    model: Model | linear.LinearModel | ForestModel
    train_seconds: float

    def forecast(self, table: DataFrame) -> DataFrame:
        """Rows of `table` with `yhat`, back on the count scale and never negative."""
        raw = F.col("prediction")
        value = F.expm1(raw) if self.variant == "log1p" else raw
        scored = self.model.transform(table).withColumn("yhat", F.greatest(value, F.lit(0.0)))
        return scored.drop("features", "label", "prediction")

    def predictions(self, table: DataFrame) -> DataFrame:
        return self.forecast(table).select(
            F.lit(self.name).alias("model_name"), F.lit(self.variant).alias("variant"), "split", "zone_id",
            "created_date", "y", "yhat",
        )


def fit(name: str, train: DataFrame, params: dict | None = None, variant: str = "raw", sent: ranks.Sent | None = None) -> Fitted:
    """Fit on `train` (`label`, `features`), on log1p of the label for that variant; `sent` are those rows if they have been sent before.

    Boosted models are fitted in one task if it can hold the rows, or else by Spark, which takes several jobs for each tree.
    """
    if variant == "log1p":
        train, sent = train.withColumn("label", F.log1p("label")), sent and sent.with_log()
    start = time.monotonic()
    builder = build_model(name, params)
    if isinstance(builder, GBTRegressor):
        sent = sent or ranks.send(train)
        model = boosting.fit(sent, train.sparkSession, {"seed": SEED, **PRESETS[name], **(params or {})}) if sent else builder.fit(train)
    else:
        model = builder.fit(train) if name in LINEAR else builder.fit(train, sent=sent)
    return Fitted(name, variant, model, round(time.monotonic() - start, 3))


def variants(name: str) -> tuple[str, ...]:
    """Linear families model counts through their link and have no log1p variant."""
    return ("raw",) if name in LINEAR else ("raw", "log1p")


def fit_families(
    table: DataFrame, families: list[str] | None = None, overrides: dict[str, dict] | None = None, parallelism: int = 8
) -> list[Fitted]:
    """Every family in its variants, fitted as concurrent Spark jobs: the steps of one fit wait for each other, fits do not."""
    train = training_rows(table)
    sent = ranks.send(train)
    wanted = [(name, variant) for name in families or list(PRESETS) for variant in variants(name)]
    # forests, whose many tasks fill what is left of the cores, begin last
    order = sorted(range(len(wanted)), key=lambda i: "numTrees" in PRESETS[wanted[i][0]])
    with ThreadPool(parallelism) as pool:
        done = pool.map(lambda i: fit(wanted[i][0], train, (overrides or {}).get(wanted[i][0]), wanted[i][1], sent), order, chunksize=1)
    return [fitted for _, fitted in sorted(zip(order, done), key=lambda p: p[0])]


def benchmark(split_rows: DataFrame, table: DataFrame, fits: list[Fitted], parallelism: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The long forecasts of `fits` and of the baselines, the leaderboard, and the seconds each model took.

    Both baselines have both variants with the same forecast. Forecasts of one model are written as one table, next to those of others, which
    is also what inference time measures. `table` is the `training_table` of `split_rows`.
    """
    held_out = table.filter("split <> 'train'")
    base = materialize(baseline_predictions(split_rows), "baseline")
    parts, timings = [base, base.withColumn("variant", F.lit("log1p"))], []

    def forecast(fitted: Fitted) -> tuple[DataFrame, float]:
        start = time.monotonic()
        return materialize(fitted.predictions(held_out), "forecast"), round(time.monotonic() - start, 4)

    with ThreadPool(parallelism) as pool:
        for fitted, (part, seconds) in zip(fits, pool.map(forecast, fits, chunksize=1)):
            parts.append(part)
            timings.append((fitted.name, fitted.variant, fitted.train_seconds, seconds))
    preds = reduce(DataFrame.unionByName, parts)
    seconds = split_rows.sparkSession.createDataFrame(
        timings, "model_name string, variant string, train_time_s double, inference_time_s double"
    )
    return preds, leaderboard(preds), seconds


def with_seconds(board: DataFrame, seconds: DataFrame) -> DataFrame:
    """The leaderboard as it is published; baselines take no time."""
    timed = board.join(seconds, ["model_name", "variant"], "left").na.fill({"train_time_s": 0.0, "inference_time_s": 0.0})
    return timed.orderBy(F.desc("val_p10"), "model_name", "variant")


def refit(tuning: list[tuple[str, str]], table: DataFrame) -> list[Fitted]:
    """Fit each tuned model again from its stored JSON parameters."""
    train = training_rows(table)
    return [fit(name, train, json.loads(params)) for name, params in tuning]


def save_model(fitted: Fitted, path: str) -> None:
    """Store a fitted model so that `load_model` can read it whatever its family; forests kept as tables are stored by their parameters only."""
    if isinstance(fitted.model, linear.LinearModel):
        from pyspark.sql import SparkSession

        return fitted.model.save(SparkSession.active(), path)
    if isinstance(fitted.model, boosting.BoostedModel):
        return fitted.model.save(path)
    if isinstance(fitted.model, ForestModel):
        raise ValueError("such forests are fitted again from their parameters")
    PipelineModel([fitted.model]).write().overwrite().save(path)


def load_model(name: str, variant: str, path: str) -> Fitted:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    if name in LINEAR:
        return Fitted(name, variant, linear.LinearModel.load(spark, path), 0.0)
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/boosted")
    if own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own):
        return Fitted(name, variant, boosting.BoostedModel.load(spark, path), 0.0)
    return Fitted(name, variant, PipelineModel.load(path), 0.0)


def importances(models: list[Fitted]) -> DataFrame:
    """`feature, model_name, importance, average`: shares that sum to 1 per model and their mean over models.

    One row per feature and model, whatever the data.
    """
    from pyspark.sql import SparkSession

    rows = [
        (feature, m.name, float(value))
        for m in models for feature, value in zip(FEATURES, m.model.featureImportances.toArray())
    ]
    raw = SparkSession.active().createDataFrame(rows, "feature string, model_name string, value double")
    return normalise_importances(raw)


def normalise_importances(raw: DataFrame) -> DataFrame:
    # a model without a split has importance nowhere
    share = F.coalesce(F.try_divide("value", F.sum("value").over(Window.partitionBy("model_name"))), F.lit(0.0))
    mean = F.avg("importance").over(Window.partitionBy("feature"))
    return raw.withColumn("importance", share).withColumn("average", mean).select(
        "feature", "model_name", "importance", "average"
    )


def importance_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One column per model plus the average, strongest first."""
    wide = long.groupBy("feature").pivot("model_name", names).agg(F.max("importance"))
    mean = long.groupBy("feature").agg(F.max("average").alias("average"))
    return wide.join(mean, "feature").orderBy(F.desc("average"), "feature")


def top_features(long: DataFrame, k: int = 15) -> DataFrame:
    """The `k` features with the highest average, with their place from 1; a report shows the first 15, 10 or 5."""
    best = long.groupBy("feature").agg(F.max("average").alias("average")).orderBy(F.desc("average"), "feature").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("average"), "feature")))


def leading_features(long: DataFrame, k: int = 10) -> DataFrame:
    """Strongest feature of each model among the `k` features with the highest average."""
    top = long.groupBy("feature").agg(F.max("average").alias("a")).orderBy(F.desc("a"), "feature").limit(k)
    return long.join(top, "feature", "left_semi").groupBy("model_name").agg(
        F.max_by("feature", F.struct("importance", "feature")).alias("leading_feature")
    )


# What each model input measures, for display next to its importance.
DESCRIPTIONS = {
    "centroid_lat": "Mean latitude of the records of the zone.",
    "centroid_lon": "Mean longitude of the records of the zone.",
    "lat_std": "How far the records spread north and south.",
    "lon_std": "How far the records spread east and west.",
    "violation_density": "Records of the zone for each unit of its area.",
    "unique_violation_types": "Number of different offences seen in the zone.",
    "unique_vehicle_classes": "Number of different vehicle classes seen in the zone.",
    "unique_locations": "Number of different addresses in the zone.",
    "unique_junctions": "Number of different junctions in the zone.",
    "recurring_hotspot_flag": "1 if the zone was busy in several months.",
    "month_over_month_trend": "Slope of the monthly record counts.",
    "peak_share": "Part of the records that fall into peak hours.",
    "hotspot_band_num": "Severity band of the zone as a number.",
    "day_of_week": "Weekday of the row, Monday is 0.",
    "is_weekend": "1 on Saturdays and Sundays.",
    "month": "Calendar month of the row.",
    "week_of_month": "Which seven days of the month the row lies in.",
    "is_peak_season": "1 in the months set as the busy season.",
    "lag_1_count": "Records one observed day before the previous one.",
    "lag_3_count": "Records three observed days back.",
    "lag_7_count": "Records seven observed days back.",
    "lag_14_count": "Records fourteen observed days back.",
    "rolling_7d_sum": "Records over the seven observed days before.",
    "rolling_7d_mean": "Daily mean over the seven observed days before.",
    "rolling_14d_sum": "Records over the fourteen observed days before.",
    "rolling_14d_mean": "Daily mean over the fourteen observed days before.",
    "lag_1_parking_count": "Parking records at the same lag as lag_1_count.",
    "rolling_7d_parking_sum": "Parking records over the seven observed days before.",
    "lag_1_peak_hour_count": "Peak-hour records at the same lag as lag_1_count.",
    "rolling_7d_peak_hour_sum": "Peak-hour records over the seven observed days before.",
    "days_since_last_violation": "Observed days since the zone last had a record.",
    "count_growth_rate_7d": "Growth of the count against seven observed days back.",
    "count_growth_rate_14d": "Growth of the count against fourteen observed days back.",
}
DEFAULT_DESCRIPTION = "Model feature weight."


def described(long: DataFrame) -> DataFrame:
    from zonecast.functions.scalars import lookup

    return long.withColumn("description", lookup(F.col("feature"), DESCRIPTIONS, DEFAULT_DESCRIPTION))
