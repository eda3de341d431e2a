"""Every registered query as a function of a workspace. All of them read the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.functions import scalars as S
from zonecast.operators import (
    attribution, cleaning, deployment, entities, evaluation, extra_trees, heatmap, impact, linear, models, panel, reports, tuning, zones
)
from zonecast.operators.dbscan import distinct_points, split_usable
from zonecast.plans.workspace import Workspace
from zonecast.session import materialize, scratch_root
from zonecast.sources import marts, schemas

Query = Callable[[Workspace], DataFrame]
QUERIES: dict[str, Query] = {}

OFFICERS, TRUCKS = 20, 2


def fixed(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and doubles to six digits, so that two engines that add in another order print the same.

    The cut lies just below the half, where no short decimal or simple fraction falls.
    """
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.floor(c * 1e6 + 0.5001) / 1e6
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.BooleanType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda w: fixed(fn(w))
    return fn


# -- sources and cleaning ------------------------------------------------------------------------------------------


@query
def event_time_parts(w: Workspace) -> DataFrame:
    """Local date, hour and calendar flags of every event."""
    local = cleaning.time_parts(w.table("events", ["event_id", "ts"]), "ts")
    return cleaning.calendar_flags(local).drop("ts")


@query
def record_features(w: Workspace) -> DataFrame:
    return w.records.select(
        "id", "latitude", "longitude", "time_bucket", "is_peak_hour", "is_weekend", "created_day_name",
        "created_month_name", "geo_cell", "recency_weight",
    )


@query
def record_location_load(w: Workspace) -> DataFrame:
    loaded = cleaning.location_load(w.records.select("id", "location_clean", "vehicle_class"), "location_clean", "vehicle_class")
    return loaded.select("id", "location_clean", "location_frequency", "vehicle_density")


@query
def record_category_codes(w: Workspace) -> DataFrame:
    coded = cleaning.encode_category(w.records.select("id", "primary_violation", "vehicle_class"), "primary_violation")
    coded = cleaning.encode_category(coded, "vehicle_class")
    return coded.select("id", "primary_violation_code", "vehicle_class_code")


@query
def part_word_counts(w: Workspace) -> DataFrame:
    """Type counts of an array column: words of the part name, two of them in the counted list."""
    words = w.table("part", ["p_partkey", "p_name"]).withColumn("types", F.split("p_name", " "))
    counted = cleaning.violation_counts(words, "types", ["widget", "bolt"])
    return counted.select(
        "p_partkey", "parking_related_violation_count", "non_parking_violation_count", "primary_violation"
    )


@query
def order_days_since_start(w: Workspace) -> DataFrame:
    orders = w.table("orders", ["o_orderkey", "o_orderdate"])
    return cleaning.days_since_start(orders, "o_orderdate").select("o_orderkey", "days_since_start")


@query
def normalised_keys(w: Workspace) -> DataFrame:
    named = w.table("supplier").withColumnRenamed("s_name", "  Zone   Key ")
    named = cleaning.normalise_columns(named)
    return named.select("s_suppkey", cleaning.normalise_key(F.col("zone_key")).alias("zone_key"))


@query
def coordinate_quarantine(w: Workspace) -> DataFrame:
    """Counts on both sides of the coordinate check, with records that name no street taken as not located."""
    broken = w.records.withColumn("latitude", F.when(F.col("location_first_segment").isNotNull(), F.col("latitude")))
    good, bad = split_usable(broken)
    sides = good.select(F.lit("usable").alias("side")).unionByName(bad.select(F.lit("quarantined").alias("side")))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query
def point_weights(w: Workspace) -> DataFrame:
    return distinct_points(w.records)


@query
def record_conservation(w: Workspace) -> DataFrame:
    _, bad = split_usable(w.records)
    return zones.check_conservation(w.records, w.labelled, bad)


@query
def score_bounds(w: Workspace) -> DataFrame:
    return zones.check_scores(w.zones)


@query
def mart_round_trip(w: Workspace) -> DataFrame:
    """Zones written as CSV and as Parquet, read back through the catalog and through the declared schema."""
    root = f"{scratch_root(w.spark)}/marts-{w.key}"
    marts.write_mart(w.zones, f"{root}/csv/hotspot_zones", "csv")
    marts.write_mart(w.zones, f"{root}/parquet/hotspot_zones")
    text = marts.read_csv(w.spark, f"{root}/csv/hotspot_zones", schemas.HOTSPOT_ZONES)
    columns = marts.load_catalog(w.spark, f"{root}/parquet")["hotspot_zones"]
    pick = ["zone_id", "zone_name", "hotspot_score", "total_violations"]
    return columns.select(*pick).join(
        text.select("zone_id", F.col("hotspot_score").alias("csv_score"), F.col("hotspot_band").alias("csv_band")), "zone_id"
    )


@query
def panel_months(w: Workspace) -> DataFrame:
    """Rows per month of the panel after its partitioned write."""
    path = f"{scratch_root(w.spark)}/panel-{w.key}"
    marts.write_panel(w.features, path)
    return marts.read_table(w.spark, path).groupBy("panel_month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("daily_violation_count").alias("violations")
    ).withColumn("panel_month", F.col("panel_month").cast("string"))


@query
def panel_appended(w: Workspace) -> DataFrame:
    """Sums by month of a panel that was written up to a date and had the later dates appended."""
    path, cut = f"{scratch_root(w.spark)}/appended-{w.key}", "2024-03-11"
    marts.write_panel(panel.zone_daily_features(w.cube.filter(F.col("created_date") < cut), w.zones), path)
    marts.append_panel(panel.appended_features(w.cube, w.zones, cut), path)
    sums = [F.sum(c).alias(c) for c in ("daily_violation_count", "rolling_14d_sum", "days_since_last_violation", "count_growth_rate_14d", panel.TARGET)]
    rows = marts.read_table(w.spark, path)
    return rows.groupBy(F.col("panel_month").cast("string").alias("panel_month")).agg(F.count(F.lit(1)).alias("n"), *sums)


#: Every so many records a line of the CSV table is spoilt, in one of three ways.
SPOILT = 50


@query
def csv_rejects(w: Workspace) -> DataFrame:
    """Records written as CSV lines of which some are spoilt, read back: lines by what became of them."""
    path = f"{scratch_root(w.spark)}/lines-{w.key}"
    names, at = schemas.RECORDS.fieldNames(), F.col("id") % SPOILT
    rows = w.records.select(*names)
    cells = {c: F.col(c).cast("string") for c in names} | {
        "created_date": F.when(at == 2, "2024-13-45").otherwise(F.col("created_date").cast("string")),
        "latitude": F.when(at == 3, "north").otherwise(F.col("latitude").cast("string")),
    }
    cells = [cells[c].alias(c) for c in names]
    line = F.when(at == 1, F.to_csv(F.struct(*cells[:-1]))).otherwise(F.to_csv(F.struct(*cells)))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)
    good, rejected = marts.read_csv_checked(w.spark, path, schemas.RECORDS, header=False)
    counted = rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    accepted = good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("reason"), "n")
    read = counted.unionByName(accepted)
    return read.unionByName(read.agg(F.sum("n").alias("n")).select(F.lit("input").alias("reason"), "n"))


@query
def ordered_marts(w: Workspace) -> DataFrame:
    """Zones and recommendations as written in order, read back from several files with the place of each row."""
    root = f"{scratch_root(w.spark)}/ordered-{w.key}"
    zone_order = [F.desc("hotspot_score"), F.desc("total_violations"), F.col("zone_id")]
    marts.write_ordered(w.zones, f"{root}/zones", zone_order)
    marts.write_ordered(w.recs, f"{root}/recommendations", deployment.risk_order())
    read = lambda name: marts.read_table(w.spark, f"{root}/{name}", ["zone_id", "position"])
    return read("zones").withColumn("mart", F.lit("zones")).unionByName(read("recommendations").withColumn("mart", F.lit("recommendations")))


@query
def parameter_map(w: Workspace) -> DataFrame:
    """JSON text to a map: the properties of every event."""
    parsed = w.table("events", ["event_id", "props"]).withColumn("m", marts.parse_parameters(F.col("props")))
    return parsed.select("event_id", F.element_at("m", F.lit("k")).alias("k"))


# -- heatmap -------------------------------------------------------------------------------------------------------


@query
def temporal_heatmap(w: Workspace) -> DataFrame:
    return w.heatmap


@query
def heatmap_pivot(w: Workspace) -> DataFrame:
    return heatmap.heatmap_matrix(w.heatmap)


@query
def heatmap_peaks(w: Workspace) -> DataFrame:
    return heatmap.heatmap_peaks(w.heatmap)


@query
def heat_intensity(w: Workspace) -> DataFrame:
    return heatmap.heat_intensity(w.heatmap)


# -- panel ---------------------------------------------------------------------------------------------------------

_KEY = ["zone_id", "created_date"]


@query
def daily_panel(w: Workspace) -> DataFrame:
    return w.panel.select(*_KEY, *panel.COUNTS)


@query
def panel_lags(w: Workspace) -> DataFrame:
    return panel.lag_features(w.panel).drop("date_index", *panel.COUNTS)


@query
def panel_rolling(w: Workspace) -> DataFrame:
    return panel.rolling_features(w.panel).drop("date_index", *panel.COUNTS)


@query
def rows_since_last(w: Workspace) -> DataFrame:
    return panel.recency_feature(w.panel).select(*_KEY, "days_since_last_violation")


@query
def growth_rates(w: Workspace) -> DataFrame:
    grown = panel.growth_features(panel.rolling_features(w.panel))
    return grown.select(*_KEY, "count_growth_rate_7d", "count_growth_rate_14d")


@query
def calendar_features(w: Workspace) -> DataFrame:
    return panel.calendar_features(w.panel).drop("date_index", *panel.COUNTS)


@query
def next_day_target(w: Workspace) -> DataFrame:
    return panel.target_feature(w.panel).select(*_KEY, panel.TARGET)


@query
def zone_daily_features(w: Workspace) -> DataFrame:
    return w.features


def lineitem_panel(w: Workspace) -> DataFrame:
    """Suppliers as zones and ship dates as days over the whole line item table."""
    items = w.table("lineitem", ["l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_quantity"]).select(
        F.col("l_suppkey"), F.to_date("l_shipdate").alias("day"), F.col("l_orderkey"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"), (F.col("l_quantity") > 25).cast("int").alias("large"),
    )
    daily = materialize(panel.daily_counts(items, "l_suppkey", "day", "l_orderkey", "returned", "large"), "daily")
    return panel.dense_panel(daily, panel.observed_dates(items, "day"))


@query
def panel_lineitem(w: Workspace) -> DataFrame:
    timed = panel.time_features(lineitem_panel(w))
    return timed.select(
        *_KEY, *panel.COUNTS, "lag_7_count", "rolling_7d_sum", "rolling_14d_mean", "days_since_last_violation",
        "count_growth_rate_7d", panel.TARGET,
    )


# -- clusters and zones --------------------------------------------------------------------------------------------


@query
def dbscan_labels(w: Workspace) -> DataFrame:
    return w.clustering.point_labels()


@query
def zone_sizes(w: Workspace) -> DataFrame:
    return zones.zone_numbers(w.clustering).select("zone_id", "records")


@query
def record_zones(w: Workspace) -> DataFrame:
    return w.labelled.select("id", "zone_id")


@query
def noise_stats(w: Workspace) -> DataFrame:
    return zones.noise_stats(w.labelled)


@query
def zone_geometry(w: Workspace) -> DataFrame:
    sized = zones.zone_geometry(zones.zone_totals(w.labelled))
    return sized.select("zone_id", "centroid_lat", "centroid_lon", "lat_std", "lon_std", "area_m2", "violation_density")


@query
def grid_cells(w: Workspace) -> DataFrame:
    return zones.grid_cells(w.records)


@query
def hotspot_zones(w: Workspace) -> DataFrame:
    return w.zones


@query
def zone_modes(w: Workspace) -> DataFrame:
    return zones.zone_modes(w.labelled)


@query
def zone_trend(w: Workspace) -> DataFrame:
    months = zones.trend_columns(zones.zone_totals(w.labelled))
    return months.select("zone_id", *zones.MONTH_COLUMNS, "month_over_month_trend", "recurring_hotspot_flag")


@query
def zone_names(w: Workspace) -> DataFrame:
    """Zone names with the placeholder junction taken away where it is the only one."""
    return w.zones.select("zone_id", "zone_name", S.clean_junction(F.col("top_junction")).alias("junction"))


@query
def zone_bands(w: Workspace) -> DataFrame:
    return w.zones.select("zone_id", "hotspot_score", "hotspot_band")


@query
def top_hotspots(w: Workspace) -> DataFrame:
    return reports.top_hotspots(w.zones).select("zone_id", "zone_name", "hotspot_score", "hotspot_band", "peak_share")


@query
def leading_names(w: Workspace) -> DataFrame:
    return reports.leading_names(w.zones, "Medium")


@query
def map_summary(w: Workspace) -> DataFrame:
    return reports.map_summary(w.zones)


@query
def severity_distribution(w: Workspace) -> DataFrame:
    return reports.severity_distribution(w.zones)


@query
def summary_report(w: Workspace) -> DataFrame:
    return w.summary


@query
def kpis(w: Workspace) -> DataFrame:
    return reports.kpis(w.summary, evaluation.best_model(w.board))


@query
def location_ranking(w: Workspace) -> DataFrame:
    return w.ranking


@query
def top_entities(w: Workspace) -> DataFrame:
    return entities.top_entities(w.ranking, "Junction")


# -- evaluation ----------------------------------------------------------------------------------------------------


@query
def chrono_split(w: Workspace) -> DataFrame:
    return w.split_rows.groupBy("split").agg(
        F.countDistinct("created_date").alias("dates"), F.count(F.lit(1)).alias("n"),
        F.min("created_date").alias("first_date"), F.max("created_date").alias("last_date"),
    )


@query
def baseline_metrics(w: Workspace) -> DataFrame:
    return evaluation.regression_metrics(evaluation.baseline_predictions(w.split_rows), ["model_name", "split"])


@query
def daily_precision_at_k(w: Workspace) -> DataFrame:
    return evaluation.daily_precision_at_k(w.baselines, ["model_name", "split"], per_day=True)


_FORECAST = ["model_name", "split", "zone_id", "created_date", "y", "yhat"]


@query
def blend_simple(w: Workspace) -> DataFrame:
    return evaluation.blend(evaluation.baseline_predictions(w.split_rows), evaluation.SIMPLE_BLEND).select(*_FORECAST)


@query
def blend_weighted(w: Workspace) -> DataFrame:
    singles = evaluation.baseline_predictions(w.split_rows)
    return evaluation.blend(singles, evaluation.WEIGHTED_BLEND, evaluation.blend_weights(singles)).select(*_FORECAST)


@query
def blend_weights(w: Workspace) -> DataFrame:
    return evaluation.blend_weights(evaluation.baseline_predictions(w.split_rows))


@query
def baseline_leaderboard(w: Workspace) -> DataFrame:
    return w.board


@query
def leaderboard_long(w: Workspace) -> DataFrame:
    return evaluation.leaderboard_long(w.board)


@query
def eval_wide(w: Workspace) -> DataFrame:
    return evaluation.eval_wide(w.baselines, {"Persistence (lag_1)": "baseline", "Rolling 7d Mean": "rolling"})


@query
def best_model(w: Workspace) -> DataFrame:
    return evaluation.best_model(w.board)


@query
def uplift(w: Workspace) -> DataFrame:
    return evaluation.uplift(w.board)


@query
def error_analysis(w: Workspace) -> DataFrame:
    return w.errors


@query
def error_histogram(w: Workspace) -> DataFrame:
    return evaluation.error_histogram(w.errors)


@query
def error_stats(w: Workspace) -> DataFrame:
    return evaluation.error_stats(w.errors)


@query
def error_drilldown(w: Workspace) -> DataFrame:
    return evaluation.error_drilldown(w.errors, 0.5, 1.0)


@query
def best_worst_zones(w: Workspace) -> DataFrame:
    return evaluation.best_and_worst(w.errors, 5)


# -- deployment ----------------------------------------------------------------------------------------------------


@query
def risk_percentiles(w: Workspace) -> DataFrame:
    day = deployment.last_day(w.features).withColumn("yhat", F.col("rolling_7d_mean"))
    return deployment.risk_percentiles(day).select("zone_id", deployment.FORECAST, "predicted_pct")


@query
def recommendations(w: Workspace) -> DataFrame:
    return w.recs


@query
def top_deployments(w: Workspace) -> DataFrame:
    return deployment.top_deployments(w.recs).select("zone_id", "predicted_risk_score", "needs_towing")


@query
def recs_old_vs_new(w: Workspace) -> DataFrame:
    return deployment.compare_top(w.recommend("lag_1_count"), w.recs)


@query
def forecast_table(w: Workspace) -> DataFrame:
    return deployment.forecast_table(w.recs, "High")


@query
def allocation(w: Workspace) -> DataFrame:
    return deployment.allocate(w.recs, OFFICERS, TRUCKS)


@query
def top_allocations(w: Workspace) -> DataFrame:
    return deployment.top_allocations(deployment.allocate(w.recs, OFFICERS, TRUCKS))


@query
def coverage(w: Workspace) -> DataFrame:
    return deployment.coverage(w.recs, OFFICERS, TRUCKS)


# -- impact and map ------------------------------------------------------------------------------------------------


@query
def impact_score(w: Workspace) -> DataFrame:
    return impact.impact(w.zones).select("zone_id", "impact_score", "capacity_loss", "peak_label", "short_name", "chart_label")


@query
def impact_top(w: Workspace) -> DataFrame:
    return impact.top_impact(impact.impact(w.zones), 8).select("zone_id", "impact_score", "capacity_loss")


@query
def impact_city(w: Workspace) -> DataFrame:
    return impact.city_impact(impact.impact(w.zones))


@query
def impact_alt(w: Workspace) -> DataFrame:
    return impact.alternative_impact(w.zones)


@query
def map_layer(w: Workspace) -> DataFrame:
    return impact.map_layer(w.zones)


@query
def map_filtered(w: Workspace) -> DataFrame:
    return impact.map_layer(w.zones, band="Medium", bucket="night").select("zone_id", "hotspot_band", "dominant_time_bucket")


@query
def map_popup(w: Workspace) -> DataFrame:
    return impact.map_popup(impact.map_layer(w.zones).select("zone_id", "zone_name", "marker_radius"), w.recs)


@query
def stations(w: Workspace) -> DataFrame:
    return impact.stations(w.zones)


@query
def zone_inspector(w: Workspace) -> DataFrame:
    return impact.zone_inspector(w.errors, w.recs, w.zones)


@query
def sorted_by_text_number(w: Workspace) -> DataFrame:
    """Ranking sorted by a column of numbers kept as text; the place in that order is part of the result."""
    text = w.ranking.select("entity_name", F.col("total_violations").cast("string").alias("total_text"), "global_rank")
    return impact.sort_by_any(text, "total_text", "global_rank", descending=True)


# -- models whose answer SQL can give ------------------------------------------------------------------------------

WEEKDAYS = 7


@query
def saturated_fits(w: Workspace) -> DataFrame:
    """What each kind of model expects of a weekday if the weekday is all it knows and nothing is penalised: the mean."""
    rows = w.features.select("day_of_week", F.col("daily_violation_count").cast("double").alias("label"))
    day, vector = F.col("day_of_week"), VectorAssembler(inputCols=["day_of_week"], outputCol="features")
    dummies = F.array(*[(day == d).cast("double") for d in range(1, WEEKDAYS)])
    asked = rows.select("day_of_week").distinct()
    tree = {"labelCol": "label", "featuresCol": "features", "maxDepth": 8, "maxBins": 32}
    plain = {
        "poisson": lambda train: linear.fit(train.withColumn("features", dummies), 1.0, 0.0),
        "tweedie": lambda train: linear.fit(train.withColumn("features", dummies), 1.5, 0.0),
        "extra_trees": lambda train: extra_trees.fit(vector.transform(train), numTrees=5),
        "forest": lambda train: RandomForestRegressor(numTrees=3, bootstrap=False, **tree).fit(vector.transform(train)),
        "boosted": lambda train: GBTRegressor(maxIter=1, stepSize=1.0, **tree).fit(vector.transform(train)),
    }
    out = rows.groupBy("day_of_week").agg(F.count("label").alias("n"))
    for name, fit in plain.items():
        features = asked.withColumn("features", dummies) if name in ("poisson", "tweedie") else vector.transform(asked)
        out = out.join(fit(rows).transform(features).select("day_of_week", F.col("prediction").alias(name)), "day_of_week")
    return out


@query
def blend_search(w: Workspace) -> DataFrame:
    """The search at its published 50 trials over a family that needs no fit: the share of yesterday's count in a blend with the weekly mean."""
    train = w.split_rows.filter("split = 'train'").withColumn("y", F.col(panel.TARGET).cast("double"))
    blocks = materialize(tuning.with_block(train.select("zone_id", "created_date", "y", "lag_1_count", "rolling_7d_mean")), "blocks")
    trials = [{"share": i / (tuning.N_TRIALS - 1)} for i in range(tuning.N_TRIALS)]

    def forecast(params: dict, _: DataFrame, held_out: DataFrame) -> DataFrame:
        share = F.lit(params["share"])
        return held_out.withColumn("yhat", share * F.col("lag_1_count") + (1 - share) * F.col("rolling_7d_mean"))

    return tuning.rank_trials(tuning.halving(blocks, trials, forecast))


@query
def attribution_fixed_tree(w: Workspace) -> DataFrame:
    """Shapley values of all training rows for a tree of three cuts whose cuts, values and covers are those of the training rows."""
    rows = w.split_rows.filter("split = 'train'").select(
        "zone_id", "created_date", F.col("lag_1_count").cast("double").alias("lag"), F.col("rolling_7d_mean").alias("mean"),
        F.col(panel.TARGET).cast("double").alias("y"),
    )
    # one row: three cuts
    cut = rows.agg(F.avg("lag").alias("lag"), (F.floor(F.avg("mean") * 1e6) / 1e6).alias("mean")).first()
    low, high, mean = cut.lag, 2 * cut.lag, cut["mean"]
    leaf = F.when(F.col("lag") <= low, F.when(F.col("mean") <= mean, 3).otherwise(4)).otherwise(F.when(F.col("lag") <= high, 5).otherwise(6))
    found = {r.leaf: (r.v, float(r.n)) for r in rows.groupBy(leaf.alias("leaf")).agg(F.avg("y").alias("v"), F.count("y").alias("n")).collect()}
    leaves = {i: found.get(i, (0.0, 0.0)) for i in (3, 4, 5, 6)}  # four leaves
    cover = {1: leaves[3][1] + leaves[4][1], 2: leaves[5][1] + leaves[6][1]}
    table = [(0, 0, 0.0, cover[1] + cover[2], 1, 2, 0, low), (0, 1, 0.0, cover[1], 3, 4, 1, mean), (0, 2, 0.0, cover[2], 5, 6, 0, high)]
    table += [(0, i, v, n, -1, -1, -1, 0.0) for i, (v, n) in leaves.items()]
    nodes = w.spark.createDataFrame(
        table, "tree int, node int, value double, cover double, left int, right int, feature_index int, threshold double"
    )
    parts = attribution.shapley(nodes, rows.withColumn("x", F.array("lag", "mean")), ["zone_id", "created_date"], ["lag", "mean"])
    value = lambda name: F.max(F.when(F.col("feature") == name, F.col("contribution")))
    return parts.groupBy("zone_id", "created_date").agg(
        value("(base)").alias("base"), value("lag").alias("lag_part"), value("mean").alias("mean_part"), F.sum("contribution").alias("output")
    )


def derived_importances(w: Workspace) -> DataFrame:
    """Importances of two made-up models, taken from the modeling rows: mean and largest absolute value of each feature."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.col(f).cast("double")).alias("v")) for f in panel.FEATURES]))
    sizes = w.split_rows.select(each.alias("e")).groupBy("e.feature").agg(F.avg("e.v").alias("mean"), F.max("e.v").alias("peak"))
    models_of = F.explode(F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(m).alias("value")) for m in ("mean", "peak")]))
    return models.normalise_importances(sizes.select("feature", models_of.alias("m")).select("feature", "m.model_name", "m.value"))


@query
def importance_shares(w: Workspace) -> DataFrame:
    """Shares, their mean, and the sentence shown next to a feature."""
    return models.described(derived_importances(w))


@query
def top_features(w: Workspace) -> DataFrame:
    """The first 15 features by mean share, and which of them the reports of 10 and 5 show."""
    place = F.col("place")
    return models.top_features(derived_importances(w)).withColumns({"in_10": place <= 10, "in_5": place <= 5})


@query
def leading_shares(w: Workspace) -> DataFrame:
    return models.leading_features(derived_importances(w))


# -- fitted models: no SQL twin ------------------------------------------------------------------------------------


@query
def model_predictions(w: Workspace) -> DataFrame:
    return w.benchmark[0]


@query
def model_leaderboard(w: Workspace) -> DataFrame:
    """Without the seconds, which no run gives again; the job's mart has them."""
    return w.benchmark[1]


@query
def feature_importance(w: Workspace) -> DataFrame:
    long = models.importances(w.explained)
    return models.importance_wide(long, [m.name for m in w.explained])


@query
def leading_features(w: Workspace) -> DataFrame:
    return models.leading_features(models.importances(w.explained))


@query
def feature_descriptions(w: Workspace) -> DataFrame:
    return models.described(models.importances(w.explained)).select("feature", "model_name", "description")


@query
def search_results(w: Workspace) -> DataFrame:
    return w.tuning[0]


@query
def ensemble_results(w: Workspace) -> DataFrame:
    """Tuned models and their two blends, best validation precision first."""
    held_out = w.training.filter("split <> 'train'")
    # the blends, their weights and the leaderboard read the forecasts again and again
    singles = materialize(reduce(DataFrame.unionByName, [m.predictions(held_out) for m in w.tuning[1]]), "tuned")
    return evaluation.leaderboard(evaluation.with_blends(singles))


@query
def model_recommendations(w: Workspace) -> DataFrame:
    """Deployment table with a fitted model as the forecast of the last feature day."""
    day = deployment.last_day(w.features)
    kept = list(dict.fromkeys([*deployment.RECOMMENDATION_COLUMNS[:5], "lag_1_count", "hotspot_band", "dominant_time_bucket"]))
    forecast = w.explained[0].forecast(models.assemble(day, kept))
    return deployment.recommendations(forecast)


@query
def attribution_summary(w: Workspace) -> DataFrame:
    sample = attribution.sample_rows(w.training.filter("split = 'train'"))
    return attribution.mean_attribution(attribution.contributions(w.explained[0], sample), sample.count())
