"""Declared schemas of the marts and of the record source."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _D, _S, _I, _DATE = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.DateType()


def _schema(**groups) -> T.StructType:
    """Fields in the order given by `order`, typed by the group that names them."""
    order = groups.pop("order").split()
    kinds = {"long": _L, "double": _D, "text": _S, "int": _I, "date": _DATE}
    types = {name: kinds[k] for k, names in groups.items() for name in names.split()}
    return T.StructType([T.StructField(name, types.get(name, _D)) for name in order])


RECORDS = _schema(
    order="id latitude longitude created_date created_hour days_since_start parking_related_violation_count "
    "non_parking_violation_count primary_violation vehicle_class police_station_clean junction_name_clean "
    "location_first_segment location_clean",
    long="id", date="created_date", int="created_hour parking_related_violation_count non_parking_violation_count",
    text="primary_violation vehicle_class police_station_clean junction_name_clean location_first_segment "
    "location_clean",
)
HOTSPOT_ZONES = _schema(
    order="zone_id zone_name centroid_lat centroid_lon lat_std lon_std total_violations parking_related_violations "
    "non_parking_violations violation_density hotspot_score hotspot_band top_police_station top_junction top_location "
    "peak_hour_violations morning_peak_violations evening_peak_violations weekend_violations weekday_violations "
    "night_violations recency_weight_sum violations_nov violations_dec violations_jan violations_feb violations_mar "
    "violations_apr month_over_month_trend recurring_hotspot_flag dominant_hour dominant_time_bucket dominant_day_name "
    "unique_violation_types unique_vehicle_classes unique_locations unique_junctions peak_share",
    text="zone_id zone_name hotspot_band top_police_station top_junction top_location dominant_time_bucket "
    "dominant_day_name",
    long="total_violations parking_related_violations non_parking_violations peak_hour_violations "
    "morning_peak_violations evening_peak_violations weekend_violations weekday_violations night_violations "
    "unique_violation_types unique_vehicle_classes unique_locations unique_junctions violations_nov violations_dec "
    "violations_jan violations_feb violations_mar violations_apr",
    int="dominant_hour recurring_hotspot_flag",
)
LOCATION_RANKING = _schema(
    order="global_rank entity_rank entity_type entity_name hotspot_score total_violations parking_related_violations "
    "peak_hour_violations recency_weight_sum location_diversity",
    text="entity_type entity_name",
    long="global_rank entity_rank total_violations parking_related_violations peak_hour_violations location_diversity",
)
TEMPORAL_HEATMAP = _schema(
    order="day_of_week day_name hour violation_count", int="day_of_week hour", text="day_name", long="violation_count"
)
RECOMMENDATIONS = _schema(
    order="zone_id zone_name top_police_station top_junction top_location predicted_next_day_violations "
    "predicted_risk_score predicted_risk_band recommended_action manpower_estimate time_window_to_watch",
    text="zone_id zone_name top_police_station top_junction top_location predicted_risk_band recommended_action "
    "time_window_to_watch",
    int="manpower_estimate",
)
ERROR_ANALYSIS = _schema(order="zone_id actual predicted error absolute_error", text="zone_id")
LEADERBOARD = _schema(
    order="model_name variant val_mae val_rmse val_p10 test_mae test_rmse test_p10 train_time_s inference_time_s",
    text="model_name variant",
)
BEST_MODEL = _schema(order="best_model val_mae val_rmse val_p10 test_mae test_rmse test_p10", text="best_model")
SUMMARY_REPORT = _schema(order="metric_name metric_value", text="metric_name metric_value")
FEATURE_IMPORTANCE = _schema(order="feature model_name importance average", text="feature model_name")
PREDICTIONS = _schema(
    order="model_name variant split zone_id created_date y yhat", text="model_name variant split zone_id",
    date="created_date",
)
TUNING_RESULTS = T.StructType([
    T.StructField("model_name", _S), T.StructField("cv_p10", _D), T.StructField("best_params", _S),
])


def placed(schema: T.StructType) -> T.StructType:
    """Schema of an ordered mart: the place of a row is its last column."""
    return T.StructType([*schema.fields, T.StructField("position", _L)])


MARTS = {
    "hotspot_zones": placed(HOTSPOT_ZONES), "location_ranking": LOCATION_RANKING, "temporal_heatmap": TEMPORAL_HEATMAP,
    "deployment_recommendations": placed(RECOMMENDATIONS), "prediction_error_analysis": ERROR_ANALYSIS,
    "model_leaderboard": LEADERBOARD, "best_model": BEST_MODEL, "hotspot_summary_report": SUMMARY_REPORT,
    "feature_importance": FEATURE_IMPORTANCE, "predictions": PREDICTIONS,
}
