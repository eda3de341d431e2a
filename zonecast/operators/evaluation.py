"""Chronological split, baseline forecasts, metrics, blends and error reports.

Forecasts are kept long: `model_name, variant, split, zone_id, created_date, y, yhat`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.functions import scalars as S
from zonecast.operators.panel import TARGET

SPLITS = ["train", "val", "test"]
MODEL_KEY = ["model_name", "variant"]
METRICS = ["mae", "rmse", "p10"]
HISTOGRAM_EDGES = [0.0, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]


def split_dates(modeling: DataFrame, train: float = 0.75, val: float = 0.875) -> DataFrame:
    """`created_date, split`: distinct dates cut in order of time. One row per calendar day."""
    dates = modeling.select("created_date").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy("created_date"))
    cut = F.when(place <= F.floor(n * train), SPLITS[0]).when(place <= F.floor(n * val), SPLITS[1]).otherwise(SPLITS[2])
    return dates.select("created_date", cut.alias("split"))


def with_split(modeling: DataFrame) -> DataFrame:
    """Add `split` to each row; the date list is joined by broadcast, a row per calendar day."""
    return modeling.join(F.broadcast(split_dates(modeling)), "created_date")


def as_predictions(rows: DataFrame, yhat: Column, model_name: str, variant: str = "raw") -> DataFrame:
    """Long form of one forecast, negative values clipped to 0."""
    return rows.select(
        F.lit(model_name).alias("model_name"), F.lit(variant).alias("variant"), "split", "zone_id", "created_date",
        F.col(TARGET).cast("double").alias("y"), F.greatest(yhat.cast("double"), F.lit(0.0)).alias("yhat"),
    )


def baseline_predictions(split_rows: DataFrame) -> DataFrame:
    """The count two steps back and the rolling 7-day mean, in one pass."""
    held_out = split_rows.filter(F.col("split") != "train")
    guesses = F.array(
        F.struct(F.lit("Persistence (lag_1)").alias("model_name"), F.col("lag_1_count").cast("double").alias("g")),
        F.struct(F.lit("Rolling 7d Mean").alias("model_name"), F.col("rolling_7d_mean").alias("g")),
    )
    return held_out.select("split", "zone_id", "created_date", F.col(TARGET).cast("double").alias("y"),
                           F.explode(guesses).alias("e")).select(
        "e.model_name", F.lit("raw").alias("variant"), "split", "zone_id", "created_date", "y",
        F.when(F.col("e.g").isNotNull(), F.greatest(F.col("e.g"), F.lit(0.0))).alias("yhat"),
    )


def regression_metrics(preds: DataFrame, by: list[str]) -> DataFrame:
    error = F.col("yhat") - F.col("y")
    return preds.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")
    )


def day_metrics(preds: DataFrame, by: list[str], k: int) -> DataFrame:
    """A row per day: zones, hits among the `k` largest true and forecast values, and sums of errors.

    One exchange of the forecasts: both orders and all sums of a day are taken where its zones are. A day that cannot count (fewer
    than `k` zones or no event) has null hits.
    """
    day = [*by, "created_date"]
    place = lambda value: F.row_number().over(Window.partitionBy(*day).orderBy(F.desc(value), F.desc("zone_id")))
    ranked = preds.select(*day, "zone_id", "y", "yhat").withColumns({"_true": place("y"), "_guess": place("yhat")})
    error = F.col("yhat") - F.col("y")
    both = (F.col("_true") <= k) & (F.col("_guess") <= k)
    counts = (F.count(F.lit(1)) >= k) & (F.max("y") != 0)
    return ranked.groupBy(*day).agg(
        F.when(counts, F.count_if(both)).alias("_hits"), F.count(error).alias("_n"),
        F.sum(F.abs(error)).alias("_absolute"), F.sum(error * error).alias("_square"),
    )


def _precision(k: int) -> Column:
    # whole hits are summed and divided once, so the mean does not depend on the order of the days
    return F.coalesce(F.sum("_hits") / (F.count("_hits") * k), F.lit(0.0)).alias("p10")


def daily_precision_at_k(preds: DataFrame, by: list[str], k: int = 10, per_day: bool = False) -> DataFrame:
    """Share of the true top-k zones of a day found in the predicted top-k, averaged over days.

    Days with fewer than k zones or without any event do not count; with no day left the mean is 0.
    """
    daily = day_metrics(preds, by, k)
    if per_day:
        return daily.filter("_hits IS NOT NULL").select(*by, "created_date", (F.col("_hits") / float(k)).alias("precision"))
    return daily.groupBy(*by).agg(_precision(k))


def metrics_long(preds: DataFrame, k: int = 10) -> DataFrame:
    """Errors and daily precision of each model, variant and split from one exchange of the forecasts."""
    return day_metrics(preds, [*MODEL_KEY, "split"], k).groupBy(*MODEL_KEY, "split").agg(
        (F.sum("_absolute") / F.sum("_n")).alias("mae"), F.sqrt(F.sum("_square") / F.sum("_n")).alias("rmse"), _precision(k)
    )


def leaderboard(preds: DataFrame, k: int = 10, digits: int = 4) -> DataFrame:
    """One row per model and variant with validation and test metrics, best validation precision first."""
    long = metrics_long(preds, k)
    cells = [
        S.round_half_even(F.max(F.when(F.col("split") == s, F.col(m))), digits).alias(f"{s}_{m}")
        for s in ("val", "test") for m in METRICS
    ]
    return long.groupBy(*MODEL_KEY).agg(*cells).orderBy(F.desc("val_p10"), "model_name", "variant")


def leaderboard_long(board: DataFrame) -> DataFrame:
    """A row per model and split."""
    names = {"val": "Validation", "test": "Test"}
    rows = [
        F.struct(F.lit(names[s]).alias("split"), *[F.col(f"{s}_{m}").alias(m) for m in METRICS]) for s in names
    ]
    return board.select("model_name", F.explode(F.array(*rows)).alias("e")).select("e.split", "model_name", *[
        f"e.{m}" for m in METRICS
    ])


def eval_wide(preds: DataFrame, names: dict[str, str]) -> DataFrame:
    """Two rows, Validation and Test; columns `<short>_mae, <short>_rmse, <short>_p10` for each model."""
    long = metrics_long(preds).filter(F.col("split").isin("val", "test"))
    cells = [
        F.max(F.when(F.col("model_name") == full, F.col(m))).alias(f"{short}_{m}")
        for full, short in names.items() for m in METRICS
    ]
    label = F.when(F.col("split") == "val", "Validation").otherwise("Test")
    return long.groupBy(label.alias("split")).agg(*cells)


def blend_weights(preds: DataFrame) -> DataFrame:
    """Weight of each model: inverse validation error, normalised; models without any error share all of it. One row per model."""
    val = regression_metrics(preds.filter(F.col("split") == "val"), ["model_name"])
    perfect = F.max((F.col("mae") == 0).cast("int")).over(Window.partitionBy()) == 1
    alone = F.when(F.col("mae") == 0, 1.0).otherwise(0.0)
    inverse = val.select("model_name", F.when(perfect, alone).otherwise(F.try_divide(F.lit(1), "mae")).alias("_w"))
    total = F.sum("_w").over(Window.partitionBy())
    return inverse.select("model_name", (F.col("_w") / total).alias("weight"))


def blend(preds: DataFrame, name: str, weights: DataFrame | None = None) -> DataFrame:
    """Mean of the forecasts of all models, or their weighted sum."""
    key = ["split", "zone_id", "created_date"]
    if weights is None:
        mixed = preds.groupBy(*key).agg(F.max("y").alias("y"), F.avg("yhat").alias("yhat"))
    else:
        weighed = preds.join(F.broadcast(weights), "model_name")  # one weight per model
        mixed = weighed.groupBy(*key).agg(
            F.max("y").alias("y"), F.sum(F.col("weight") * F.col("yhat")).alias("yhat")
        )
    return mixed.select(F.lit(name).alias("model_name"), F.lit("raw").alias("variant"), *key, "y", "yhat")


SIMPLE_BLEND = "Ensemble (Simple Avg)"
WEIGHTED_BLEND = "Ensemble (Weighted Avg)"


def with_blends(preds: DataFrame) -> DataFrame:
    """Single models plus both blends."""
    weighted = blend(preds, WEIGHTED_BLEND, blend_weights(preds))
    return preds.unionByName(blend(preds, SIMPLE_BLEND)).unionByName(weighted)


def best_model(board: DataFrame) -> DataFrame:
    """The row with the highest validation precision; equal rows fall to the smaller name."""
    row = board.orderBy(F.desc("val_p10"), "model_name", "variant").limit(1)
    return row.select(F.col("model_name").alias("best_model"), *[f"{s}_{m}" for s in ("val", "test") for m in METRICS])


def choose_best(preds: DataFrame, board: DataFrame) -> DataFrame:
    """Forecasts of the best approach, whether a single model or a blend."""
    best = best_model(board).select(F.col("best_model").alias("model_name"))
    return preds.join(best, "model_name", "left_semi")


def uplift(board: DataFrame, better: str = "Ensemble", base: str = "Persistence") -> DataFrame:
    """Percentage points between the first row naming `better` and the first naming `base`, best precision first."""

    def first(text: str, column: str) -> Column:
        hit = F.col("model_name").contains(text)
        place = F.struct((-F.col("val_p10")).alias("p"), F.col("model_name").alias("m"))
        return F.min(F.when(hit, F.struct(place.alias("at"), F.col(column).alias("v"))))["v"]

    return board.agg(*[
        S.round_half_even((first(better, f"{s}_p10") - first(base, f"{s}_p10")) * 100, 1).alias(f"{s}_uplift_pp")
        for s in ("val", "test")
    ])


def error_analysis(preds: DataFrame) -> DataFrame:
    """Mean actual and predicted value per zone on the test split."""
    means = preds.filter(F.col("split") == "test").groupBy("zone_id").agg(
        F.avg("y").alias("actual"), F.avg("yhat").alias("predicted")
    )
    return means.withColumn("error", F.col("predicted") - F.col("actual")).withColumn(
        "absolute_error", F.abs("error")
    )


def _bin_of(error: Column, edges: list[float]) -> Column:
    return sum((error >= e).cast("int") for e in edges) - 1


def bin_label(edges: list[float], i: int) -> str:
    low = f"{edges[i]:g}"
    return f">{low}" if i == len(edges) - 1 else f"{low}-{edges[i + 1]:g}"


def error_histogram(errors: DataFrame, edges: list[float] = HISTOGRAM_EDGES) -> DataFrame:
    """Zones per half-open error range, empty ranges kept."""
    counts = errors.groupBy(_bin_of(F.col("absolute_error"), edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("zones")
    )
    bins = errors.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    labels = {i: bin_label(edges, i) for i in range(len(edges))}
    return bins.join(counts, "bin", "left").select(
        "bin", S.lookup(F.col("bin"), labels).alias("error_range"), F.coalesce("zones", F.lit(0)).alias("zones")
    )


#: Buckets of a counting pass, and passes after which the rest is one value for a double.
_BUCKETS, _PASSES = 1024, 12


def order_statistic(df: DataFrame, value: str, rank: Callable[[int], int]) -> float | None:
    """The value at place `rank(n)` (from 0) of the n values of a column that are not null; None if there are none.

    Each pass counts the values by bucket and goes on inside the bucket that holds the place, so only counts move: no sort and no
    place for each row. It ends where a bucket's least and largest value are the same, which ties reach at once.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = rows.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    place = rank(n)
    for _ in range(_PASSES):
        if low == high:
            break
        width = (high - low) / _BUCKETS
        # a range below the smallest step between doubles has two values only
        bucket = F.least(F.floor((F.col("v") - low) / width), F.lit(_BUCKETS - 1)) if width > 0 else (F.col("v") > low).cast("long")
        inside = rows.filter(F.col("v").between(low, high)).groupBy(bucket.alias("b")).agg(
            F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        for r in sorted(inside.collect(), key=lambda r: r.b):  # at most _BUCKETS rows
            if place < r.n:
                low, high = r.low, r.high
                break
            place -= r.n
    return low


def upper_median(df: DataFrame, value: str) -> float | None:
    """Element floor(n/2) of the sorted values."""
    return order_statistic(df, value, lambda n: n // 2)


def error_stats(errors: DataFrame) -> DataFrame:
    e = F.col("absolute_error")
    return errors.agg(
        F.count(F.lit(1)).alias("zones"), F.avg(e).alias("mean_error"), F.min(e).alias("min_error"),
        F.max(e).alias("max_error"), F.count_if(e < 1).alias("under_1"), F.count_if(e >= 20).alias("over_20"),
        F.coalesce(F.try_divide(F.count_if(e < 5), F.count(F.lit(1))) * 100, F.lit(0.0)).alias("under_5_percent"),
        F.max_by("zone_id", F.struct("absolute_error", "zone_id")).alias("hardest_zone"),
        F.max(F.greatest("actual", "predicted")).alias("axis_max"),
    ).withColumn("median_error", F.lit(upper_median(errors, "absolute_error")).cast("double"))


def best_and_worst(errors: DataFrame, k: int = 10) -> DataFrame:
    """The `k` smallest and the `k` largest absolute errors, as two top-k reports."""
    columns = ["zone_id", "actual", "predicted", "absolute_error"]
    best = errors.select(F.lit("best").alias("side"), *columns).orderBy("absolute_error", "zone_id").limit(k)
    worst = errors.select(F.lit("worst").alias("side"), *columns).orderBy(F.desc("absolute_error"), "zone_id").limit(k)
    return best.unionByName(worst)


def error_drilldown(errors: DataFrame, low: float, high: float | None, k: int = 10) -> DataFrame:
    """Best and worst zones inside one error range."""
    e = F.col("absolute_error")
    inside = e >= low if high is None else (e >= low) & (e < high)
    return best_and_worst(errors.filter(inside), k)
