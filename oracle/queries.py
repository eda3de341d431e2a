"""The SELECT behind each registered query, over the fragments."""

from __future__ import annotations

from oracle.fragments import RISK_ORDER, STATIC, W, big, compose, fix, half_even, norm, short_junction
from zonecast.operators.models import DESCRIPTIONS
from zonecast.operators.panel import FEATURES

TYPES = """CASE WHEN h>=8 AND h<11 THEN 'morning_peak' WHEN h>=11 AND h<17 THEN 'midday' WHEN h>=17 AND h<20
  THEN 'evening_peak' ELSE 'night' END"""
COUNTS = "daily_violation_count, daily_parking_violation_count, daily_peak_hour_count"


def _fixes(names: str) -> str:
    return ", ".join(f"{fix(n)} AS {n}" for n in names.split())


def _bigs(names: str) -> str:
    return ", ".join(f"{big(n)} AS {n}" for n in names.split())


_ZONES = (
    "zone_id, zone_name, " + _fixes("centroid_lat centroid_lon lat_std lon_std violation_density hotspot_score "
    "recency_weight_sum month_over_month_trend peak_share") + ", total_violations, parking_related_violations, "
    "non_parking_violations, hotspot_band, top_police_station, top_junction, top_location, peak_hour_violations, "
    "morning_peak_violations, evening_peak_violations, weekend_violations, weekday_violations, night_violations, "
    "unique_violation_types, unique_vehicle_classes, unique_locations, unique_junctions, violations_nov, "
    "violations_dec, violations_jan, violations_feb, violations_mar, violations_apr, dominant_time_bucket, "
    "dominant_day_name, " + _bigs("dominant_hour recurring_hotspot_flag")
)
_STATIC_DOUBLE = "centroid_lat centroid_lon lat_std lon_std violation_density month_over_month_trend peak_share".split()
_STATIC = ", ".join(
    f"{fix(c)} AS {c}" if c in _STATIC_DOUBLE else f"{big(c)} AS {c}" if c == "recurring_hotspot_flag" else c for c in STATIC
)
_LAGS = "lag_1_count, lag_3_count, lag_7_count, lag_14_count, lag_1_parking_count, lag_1_peak_hour_count"
_PREV = "lag_1_count AS prev_day_count, lag_1_parking_count AS prev_day_parking, lag_1_peak_hour_count AS prev_day_peak"
_ROLL = "rolling_7d_sum, rolling_14d_sum, rolling_7d_parking_sum, rolling_7d_peak_hour_sum, " + _fixes(
    "rolling_7d_mean rolling_14d_mean"
)
_CAL = "day_of_week, month, week_of_month, " + _bigs("is_weekend is_peak_season")
_BOARD = "model_name, variant, " + _fixes("val_mae val_rmse val_p10 test_mae test_rmse test_p10")
_RECS = (
    "zone_id, zone_name, top_police_station, top_junction, top_location, predicted_risk_band, recommended_action, "
    "time_window_to_watch, " + _fixes("predicted_next_day_violations predicted_risk_score") + ", " + _bigs("manpower_estimate")
)
_ERR = "zone_id, " + _fixes("actual predicted error absolute_error")
_SPLIT_NAME = "CASE WHEN split='val' THEN 'Validation' ELSE 'Test' END"
_BINS = [0, 0.5, 1, 2, 5, 10, 20, 50, 100]
_LABELS = [f"{a:g}-{b:g}" for a, b in zip(_BINS, _BINS[1:])] + [">100"]


def _best_worst(where: str, k: int) -> str:
    cols = "zone_id, " + _fixes("actual predicted absolute_error")
    return f"""SELECT * FROM (SELECT 'best' AS side, {cols} FROM (SELECT * FROM err WHERE {where} ORDER BY absolute_error, zone_id LIMIT {k}))
      UNION ALL SELECT * FROM (SELECT 'worst' AS side, {cols} FROM (SELECT * FROM err WHERE {where} ORDER BY absolute_error DESC, zone_id LIMIT {k}))"""


def _top_side(table: str, side: str) -> str:
    return f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY predicted_risk_score DESC, p DESC, zone_id) AS place,
      zone_id AS {side}_zone_id, p AS {side}_predicted_next_day_violations, predicted_risk_score AS {side}_predicted_risk_score,
      predicted_risk_band AS {side}_predicted_risk_band FROM {table}) WHERE place<=10"""


_LINE = f"""WITH d AS (SELECT l_suppkey AS zone_id, CAST(l_shipdate AS DATE) AS created_date, count(l_orderkey) AS c,
  {big("sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END)")} AS p, {big("sum(CASE WHEN l_quantity>25 THEN 1 ELSE 0 END)")} AS k
  FROM lineitem GROUP BY 1,2),
g AS (SELECT z.zone_id, t.created_date, coalesce(d.c,0) AS daily_violation_count, coalesce(d.p,0) AS daily_parking_violation_count,
  coalesce(d.k,0) AS daily_peak_hour_count, row_number() OVER (PARTITION BY z.zone_id ORDER BY t.created_date) AS ix
  FROM (SELECT DISTINCT zone_id FROM d) z CROSS JOIN (SELECT DISTINCT created_date FROM d) t
  LEFT JOIN d ON d.zone_id=z.zone_id AND d.created_date=t.created_date),
a AS (SELECT *, lag(daily_violation_count,7) OVER ({W}) AS lag_7_count,
  lead(daily_violation_count,1) OVER ({W}) AS next_day_violation_count,
  CASE WHEN ix>7 THEN {big(f"sum(daily_violation_count) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")} END AS rolling_7d_sum,
  CASE WHEN ix>7 THEN avg(daily_violation_count) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS m7,
  CASE WHEN ix>14 THEN avg(daily_violation_count) OVER ({W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) END AS m14,
  coalesce(ix-max(CASE WHEN daily_violation_count>0 THEN ix END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),90)
    AS days_since_last_violation FROM g),
b AS (SELECT *, lag(m7,7) OVER ({W}) AS b7 FROM a)
SELECT zone_id, created_date, {COUNTS}, lag_7_count, rolling_7d_sum, {fix('m14')} AS rolling_14d_mean,
  days_since_last_violation, {fix('(m7-b7)/(b7+1e-5)')} AS count_growth_rate_7d, next_day_violation_count FROM b"""

_METRIC_ROWS = [
    ("Total Violations Processed", "CAST(a.n AS VARCHAR)"), ("Clustered Violations (in Zones)", "CAST(a.i AS VARCHAR)"),
    ("Noise Violations (outside Zones)", "CAST(a.n-a.i AS VARCHAR)"),
    ("Noise Violations Percentage", "printf('%.2f%%', (a.n-a.i)/a.n*100)"),
    ("Total Geo Clusters (Zones) Detected", "CAST(z.n AS VARCHAR)"),
    *[(f"{b} Severity Zones", f"CAST((SELECT count(*) FROM zones WHERE hotspot_band='{b}') AS VARCHAR)")
      for b in ("Very High", "High", "Medium", "Low")],
    ("Most Common Police Station in Hotspots", """(SELECT police_station_clean FROM lab WHERE zone_id<>'ZONE_NOISE'
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""),
    ("Peak Hour Violations Share in Hotspots", "printf('%.2f%%', a.peak*100)"),
    ("Top Hotspot Zone ID", "z1.zone_id"), ("Top Hotspot Zone Name", "z1.zone_name"),
    ("Top Hotspot Zone Score", "printf('%.2f', z1.hotspot_score)"),
]
_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{n}' AS metric_name, {v} AS metric_value FROM
      (SELECT count(*) AS n, count(*) FILTER (zone_id<>'ZONE_NOISE') AS i, avg(is_peak_hour) FILTER (zone_id<>'ZONE_NOISE') AS peak FROM lab) a,
      (SELECT count(*) AS n FROM zones) z, (SELECT * FROM zones WHERE ord=1) z1""" for n, v in _METRIC_ROWS
)

_ABSOLUTE = ", ".join(f"abs(CAST({f} AS DOUBLE))" for f in FEATURES)
_SIZES = f"""SELECT feature, avg(v) AS mean, max(v) AS peak FROM (SELECT unnest({FEATURES}) AS feature, unnest([{_ABSOLUTE}]) AS v FROM modl) GROUP BY 1"""
_SHARES = f"""SELECT feature, model_name, importance, avg(importance) OVER (PARTITION BY feature) AS average FROM (
      SELECT feature, 'mean' AS model_name, mean/sum(mean) OVER () AS importance FROM ({_SIZES})
      UNION ALL SELECT feature, 'peak', peak/sum(peak) OVER () FROM ({_SIZES}))"""
_TOP = f"""SELECT feature, average, row_number() OVER (ORDER BY average DESC, feature) AS place FROM (
      SELECT feature, max(average) AS average FROM ({_SHARES}) GROUP BY 1)"""
_DESCRIBED = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{text}'" for f, text in DESCRIPTIONS.items()) + " END"
SELECTS: dict[str, str] = {
    "event_time_parts": f"""SELECT event_id, CAST(l AS DATE) AS created_date, h AS created_hour, {TYPES} AS time_bucket,
      {big('CASE WHEN h>=8 AND h<11 THEN 1 ELSE 0 END')} AS is_morning_peak, {big('CASE WHEN h>=17 AND h<20 THEN 1 ELSE 0 END')} AS is_evening_peak,
      {big('CASE WHEN (h>=8 AND h<11) OR (h>=17 AND h<20) THEN 1 ELSE 0 END')} AS is_peak_hour, {big('isodow(l)-1')} AS created_day_of_week,
      dayname(l) AS created_day_name, {big('CASE WHEN isodow(l)>=6 THEN 1 ELSE 0 END')} AS is_weekend, monthname(l) AS created_month_name
      FROM (SELECT event_id, ts + INTERVAL 330 MINUTE AS l, CAST(hour(ts + INTERVAL 330 MINUTE) AS BIGINT) AS h FROM events)""",
    "record_features": f"""SELECT id, {_fixes('latitude longitude recency_weight')}, time_bucket, {_bigs('is_peak_hour is_weekend')},
      created_day_name, created_month_name, geo_cell FROM rec""",
    "record_location_load": """SELECT id, location_clean, count(*) OVER (PARTITION BY location_clean) AS location_frequency,
      count(vehicle_class) OVER (PARTITION BY location_clean) AS vehicle_density FROM rec""",
    "record_category_codes": """SELECT id, a.code AS primary_violation_code, b.code AS vehicle_class_code FROM rec
      JOIN (SELECT primary_violation AS v, row_number() OVER (ORDER BY count(*) DESC, primary_violation)-1 AS code FROM rec GROUP BY 1) a ON a.v=primary_violation
      JOIN (SELECT vehicle_class AS v, row_number() OVER (ORDER BY count(*) DESC, vehicle_class)-1 AS code FROM rec GROUP BY 1) b ON b.v=vehicle_class""",
    "part_word_counts": """SELECT p_partkey, count(*) FILTER (x IN ('widget','bolt')) AS parking_related_violation_count,
      count(*) FILTER (x NOT IN ('widget','bolt')) AS non_parking_violation_count, any_value(f) AS primary_violation
      FROM (SELECT p_partkey, unnest(string_split(p_name,' ')) AS x, string_split(p_name,' ')[1] AS f FROM part) GROUP BY p_partkey""",
    "order_days_since_start": f"""SELECT o_orderkey, {fix("(epoch_us(o_orderdate)-min(epoch_us(o_orderdate)) OVER ())/86400000000")}
      AS days_since_start FROM orders""",
    "normalised_keys": "SELECT s_suppkey, upper(trim(s_name)) AS zone_key FROM supplier",
    "coordinate_quarantine": """SELECT CASE WHEN location_first_segment IS NULL THEN 'quarantined' ELSE 'usable' END AS side,
      count(*) AS n FROM rec GROUP BY 1""",
    "point_weights": f"SELECT {_fixes('lat lon')}, w AS weight FROM pts",
    "record_conservation": """SELECT count(*) FILTER (zone_id<>'ZONE_NOISE') AS clustered, count(*) FILTER (zone_id='ZONE_NOISE') AS noise,
      CAST(0 AS BIGINT) AS quarantined, (SELECT count(*) FROM rec) AS input FROM lab""",
    "score_bounds": f"SELECT {fix('min(hotspot_score)')} AS min_score, {fix('max(hotspot_score)')} AS max_score FROM zones",
    "mart_round_trip": f"""SELECT zone_id, zone_name, {fix('hotspot_score')} AS hotspot_score, total_violations,
      {fix('hotspot_score')} AS csv_score, hotspot_band AS csv_band FROM zones""",
    "panel_months": f"""SELECT strftime(created_date,'%Y-%m') AS panel_month, count(*) AS n, {big('sum(daily_violation_count)')} AS violations
      FROM panel GROUP BY 1""",
    "parameter_map": "SELECT event_id, regexp_extract(props,'[0-9]+',0) AS k FROM events",
    "temporal_heatmap": "SELECT day_of_week, day_name, hour, violation_count FROM heat",
    "heatmap_pivot": "SELECT day_of_week, day_name, " + ", ".join(
        f"{big(f'sum(CASE WHEN hour={h} THEN violation_count END)')} AS h{h}" for h in range(24)) + " FROM heat GROUP BY 1,2",
    "heatmap_peaks": f"""SELECT a.day_name AS peak_day, a.hour AS peak_hour, a.violation_count AS peak_count,
      (SELECT {big('sum(violation_count)')} FROM heat) AS total_count, b.day_name AS busiest_day, b.n AS busiest_day_count
      FROM (SELECT * FROM heat ORDER BY violation_count DESC, day_of_week, hour LIMIT 1) a,
      (SELECT day_of_week, day_name, {big('sum(violation_count)')} AS n FROM heat GROUP BY 1,2 ORDER BY 3 DESC, 1 LIMIT 1) b""",
    "heat_intensity": f"""SELECT day_of_week, hour, concat(t, CASE WHEN hour<12 THEN 'A' ELSE 'P' END) AS hour_label,
      concat(t, ':00 ', s, ' - ', CASE WHEN hour%12=0 THEN 1 ELSE hour%12+1 END, ':00 ', s) AS hour_range, left(day_name,3) AS day_label,
      {big('''CASE WHEN violation_count<=0 THEN 0 WHEN violation_count/m<0.2 THEN 1 WHEN violation_count/m<0.6 THEN 2 ELSE 3 END''')} AS heat_class,
      violation_count FROM (SELECT *, CASE WHEN hour%12=0 THEN 12 ELSE hour%12 END AS t, CASE WHEN hour<12 THEN 'AM' ELSE 'PM' END AS s,
      max(violation_count) OVER () AS m FROM heat)""",
    "daily_panel": f"SELECT zone_id, created_date, {COUNTS} FROM panel",
    "panel_lags": f"SELECT zone_id, created_date, {_LAGS}, {_PREV} FROM pw",
    "panel_rolling": f"SELECT zone_id, created_date, {_ROLL} FROM pw",
    "rows_since_last": "SELECT zone_id, created_date, days_since_last_violation FROM pw",
    "growth_rates": f"SELECT zone_id, created_date, {_fixes('count_growth_rate_7d count_growth_rate_14d')} FROM pg",
    "calendar_features": f"SELECT zone_id, created_date, {_CAL} FROM pw",
    "next_day_target": "SELECT zone_id, created_date, next_day_violation_count FROM pw",
    "zone_daily_features": f"""SELECT zone_id, created_date, {COUNTS}, {_LAGS}, {_PREV}, {_ROLL}, days_since_last_violation,
      {_fixes('count_growth_rate_7d count_growth_rate_14d')}, {_CAL}, {_STATIC}, {big('hotspot_band_num')} AS hotspot_band_num,
      next_day_violation_count FROM feat""",
    "panel_lineitem": _LINE,
    "dbscan_labels": f"""SELECT {fix('p.lat')} AS lat, {fix('p.lon')} AS lon, p.w AS weight, {fix('c.lat')} AS component_lat,
      {fix('c.lon')} AS component_lon, {big('p.is_core')} AS is_core FROM plab p LEFT JOIN pts c ON c.pid=p.c""",
    "zone_sizes": "SELECT zone_id, records FROM zid",
    "record_zones": "SELECT id, zone_id FROM lab",
    "noise_stats": f"""SELECT count(DISTINCT zone_id) FILTER (zone_id<>'ZONE_NOISE') AS n_zones, count(*) FILTER (zone_id='ZONE_NOISE')
      AS noise_records, count(*) AS all_records, {fix(half_even("count(*) FILTER (zone_id='ZONE_NOISE')/count(*)*100", 2))} AS noise_percent FROM lab""",
    "zone_geometry": f"SELECT zone_id, {_fixes('centroid_lat centroid_lon lat_std lon_std area_m2 violation_density')} FROM zrow",
    "grid_cells": """SELECT geo_cell, count(*) AS n, (SELECT count(DISTINCT geo_cell) FROM rec) AS n_cells FROM rec
      GROUP BY geo_cell ORDER BY n DESC, geo_cell LIMIT 5""",
    "hotspot_zones": f"SELECT {_ZONES} FROM zones",
    "zone_modes": f"""SELECT zone_id, top_police_station, top_junction, top_location, seg AS top_segment, {big('dominant_hour')} AS dominant_hour,
      dominant_time_bucket, dominant_day_name, unique_violation_types, unique_vehicle_classes, unique_locations, unique_junctions FROM zrow""",
    "zone_trend": f"""SELECT zone_id, violations_nov, violations_dec, violations_jan, violations_feb, violations_mar, violations_apr,
      {fix('month_over_month_trend')} AS month_over_month_trend, {big('recurring_hotspot_flag')} AS recurring_hotspot_flag FROM zrow""",
    "zone_names": f"SELECT zone_id, zone_name, {short_junction('top_junction')} AS junction FROM zones",
    "zone_bands": f"SELECT zone_id, {fix('hotspot_score')} AS hotspot_score, hotspot_band FROM zones",
    "top_hotspots": f"SELECT zone_id, zone_name, {_fixes('hotspot_score peak_share')}, hotspot_band FROM zones WHERE ord<=10",
    "leading_names": """SELECT string_agg(zone_name, ', ' ORDER BY ord) AS names FROM (SELECT * FROM zones
      WHERE hotspot_band='Medium' ORDER BY ord LIMIT 3)""",
    "map_summary": f"""SELECT count(*) AS zones, count(*) FILTER (hotspot_band='Very High') AS very_high,
      count(DISTINCT top_police_station) FILTER (top_police_station<>'') AS stations,
      (SELECT string_split(zone_name,' / ')[1] FROM zones WHERE ord=1) AS worst_zone, {fix('max(hotspot_score)')} AS worst_score FROM zones""",
    "severity_distribution": f"""SELECT {big('o')} AS band_order, b AS hotspot_band, count(zone_id) AS zones,
      {fix('count(zone_id)/(SELECT count(*) FROM zones)*100')} AS share_percent
      FROM (VALUES (0,'Very High'),(1,'High'),(2,'Medium'),(3,'Low')) v(o,b) LEFT JOIN zones ON hotspot_band=b GROUP BY o,b""",
    "summary_report": _SUMMARY,
    "kpis": f"""SELECT (SELECT count(*) FROM lab) AS total_violations, (SELECT count(*) FROM zones) AS zones,
      (SELECT count(*) FROM zones WHERE hotspot_band='Very High') AS very_high_zones,
      (SELECT printf('%.2f%%', avg(is_peak_hour)*100) FROM lab WHERE zone_id<>'ZONE_NOISE') AS peak_share,
      {fix('val_p10')} AS best_val_p10, model_name AS best_model FROM best""",
    "location_ranking": f"""SELECT global_rank, entity_rank, entity_type, entity_name, {_fixes('hotspot_score recency_weight_sum')},
      total_violations, parking_related_violations, peak_hour_violations, location_diversity FROM ent""",
    "top_entities": f"""SELECT global_rank, entity_rank, entity_type, entity_name, {_fixes('hotspot_score recency_weight_sum')},
      total_violations, parking_related_violations, peak_hour_violations, location_diversity FROM ent
      WHERE entity_type='Junction' ORDER BY global_rank LIMIT 50""",
    "chrono_split": """SELECT split, count(DISTINCT m.created_date) AS dates, count(*) AS n, min(m.created_date) AS first_date,
      max(m.created_date) AS last_date FROM modl m JOIN spd s ON s.created_date=m.created_date GROUP BY split""",
    "baseline_metrics": f"SELECT model_name, split, {_fixes('mae rmse')} FROM met WHERE model_name IN ('Persistence (lag_1)','Rolling 7d Mean')",
    "daily_precision_at_k": f"SELECT model_name, split, created_date, {fix('hits/10.0')} AS precision FROM pday WHERE hits IS NOT NULL",
    "blend_simple": f"SELECT model_name, split, zone_id, created_date, {_fixes('y yhat')} FROM preds WHERE model_name='Ensemble (Simple Avg)'",
    "blend_weighted": f"SELECT model_name, split, zone_id, created_date, {_fixes('y yhat')} FROM preds WHERE model_name='Ensemble (Weighted Avg)'",
    "blend_weights": f"SELECT model_name, {fix('weight')} AS weight FROM wts",
    "baseline_leaderboard": f"SELECT {_BOARD} FROM board",
    "leaderboard_long": " UNION ALL ".join(
        f"SELECT '{name}' AS split, model_name, {fix(f'{s}_mae')} AS mae, {fix(f'{s}_rmse')} AS rmse, {fix(f'{s}_p10')} AS p10 FROM board"
        for s, name in (("val", "Validation"), ("test", "Test"))),
    "eval_wide": f"SELECT {_SPLIT_NAME} AS split, " + ", ".join(
        fix(f"max(CASE WHEN model_name='{full}' THEN {m} END)") + f" AS {short}_{m}"
        for full, short in (("Persistence (lag_1)", "baseline"), ("Rolling 7d Mean", "rolling")) for m in ("mae", "rmse", "p10"))
        + " FROM met GROUP BY split",
    "best_model": f"SELECT model_name AS best_model, {_fixes('val_mae val_rmse val_p10 test_mae test_rmse test_p10')} FROM best",
    "uplift": "SELECT " + ", ".join(fix(half_even(
        f"""((SELECT {s}_p10 FROM board WHERE model_name LIKE '%Ensemble%' ORDER BY val_p10 DESC, model_name LIMIT 1)
        -(SELECT {s}_p10 FROM board WHERE model_name LIKE '%Persistence%' ORDER BY val_p10 DESC, model_name LIMIT 1))*100""", 1))
        + f" AS {s}_uplift_pp" for s in ("val", "test")),
    "error_analysis": f"SELECT {_ERR} FROM err",
    "error_histogram": f"""SELECT {big('b')} AS bin, l AS error_range, count(zone_id) AS zones FROM (VALUES {', '.join(
        f"({i},{lo},{hi},'{label}')" for i, (lo, hi, label) in enumerate(zip(_BINS, [*_BINS[1:], 1e300], _LABELS)))}) v(b,lo,hi,l)
      LEFT JOIN err ON absolute_error>=lo AND absolute_error<hi GROUP BY b, l""",
    "error_stats": f"""SELECT count(*) AS zones, {fix('avg(absolute_error)')} AS mean_error, {fix('min(absolute_error)')} AS min_error,
      {fix('max(absolute_error)')} AS max_error, count(*) FILTER (absolute_error<1) AS under_1, count(*) FILTER (absolute_error>=20) AS over_20,
      {fix('count(*) FILTER (absolute_error<5)/count(*)*100')} AS under_5_percent,
      (SELECT zone_id FROM err ORDER BY absolute_error DESC, zone_id DESC LIMIT 1) AS hardest_zone,
      {fix('max(greatest(actual,predicted))')} AS axis_max,
      (SELECT {fix('absolute_error')} FROM (SELECT absolute_error, row_number() OVER (ORDER BY absolute_error, zone_id)-1 AS r,
        count(*) OVER () AS n FROM err) WHERE r=n//2) AS median_error FROM err""",
    "error_drilldown": _best_worst("absolute_error>=0.5 AND absolute_error<1.0", 10),
    "best_worst_zones": _best_worst("TRUE", 5),
    "risk_percentiles": f"SELECT zone_id, {fix('p')} AS predicted_next_day_violations, {fix('pct')} AS predicted_pct FROM risk",
    "recommendations": f"SELECT {_RECS} FROM recs",
    "top_deployments": f"""SELECT zone_id, {fix('predicted_risk_score')} AS predicted_risk_score,
      {big("contains(lower(recommended_action),'towing')")} AS needs_towing FROM recs ORDER BY {RISK_ORDER} LIMIT 10""",
    "recs_old_vs_new": f"""SELECT place, old_zone_id, {_fixes('old_predicted_next_day_violations old_predicted_risk_score')}, old_predicted_risk_band,
      new_zone_id, {_fixes('new_predicted_next_day_violations new_predicted_risk_score')}, new_predicted_risk_band
      FROM ({_top_side('risk_old', 'old')}) a FULL JOIN ({_top_side('risk', 'new')}) b USING (place)""",
    "forecast_table": f"SELECT {_RECS} FROM recs WHERE predicted_risk_band='High'",
    "allocation": f"""SELECT zone_id, zone_name, predicted_risk_band, {_fixes('predicted_risk_score predicted_next_day_violations')},
      {big('req')} AS officers_required, {_bigs('officers_assigned trucks_assigned')},
      {big('floor(officers_assigned/req*100+0.5)')} AS coverage_pct FROM alloc WHERE officers_assigned>0""",
    "coverage": f"""SELECT {fix('g')} AS guided_pct, {fix('r')} AS random_pct, {fix('42.5')} AS historical_pct, {fix('g/r')} AS multiplier,
      zones_served, officers_deployed, trucks_deployed FROM (SELECT
      sum(CASE WHEN officers_assigned>0 THEN predicted_next_day_violations*officers_assigned/req ELSE 0 END)/sum(predicted_next_day_violations)*100 AS g,
      greatest(5.0, least(25.0, count(*) FILTER (officers_assigned>0)/count(*)*40+6)) AS r,
      count(*) FILTER (officers_assigned>0) AS zones_served, {big('sum(officers_assigned)')} AS officers_deployed,
      {big('sum(trucks_assigned)')} AS trucks_deployed FROM alloc)""",
    "impact_score": f"""SELECT zone_id, {fix('impact_score')} AS impact_score, capacity_loss,
      CASE dominant_time_bucket WHEN 'morning_peak' THEN 'AM Peak' WHEN 'evening_peak' THEN 'PM Peak' ELSE 'Midday' END AS peak_label,
      string_split(zone_name,' / ')[1] AS short_name, concat(left(string_split(zone_name,' / ')[1],20),'...') AS chart_label FROM imp""",
    "impact_top": f"""SELECT zone_id, {fix('impact_score')} AS impact_score, capacity_loss FROM (SELECT * FROM imp ORDER BY impact_score DESC, zone_id LIMIT 8)""",
    "impact_city": f"""SELECT {fix('avg(impact_score)')} AS mean_impact, {fix('avg(capacity_loss)')} AS mean_loss,
      count(*) FILTER (impact_score>65) AS choke_points FROM imp""",
    "impact_alt": f"""SELECT zone_id, {fix('s')} AS alt_impact, CASE WHEN s>90 THEN 'Deploy towing van + 3 officers' WHEN s>=70 THEN 'Deploy 2 officers'
      WHEN s>=50 THEN 'Patrol monitoring' ELSE 'No action needed' END AS alt_action FROM (SELECT zone_id,
      {half_even('(0.4*a+0.2*b+0.2*c+0.2*d)*100', 2)} AS s FROM (SELECT zone_id, {norm('total_violations', 'a')}, {norm('peak_hour_violations', 'b')},
      {norm('unique_vehicle_classes', 'c')}, {norm('recency_weight_sum', 'd')} FROM zones))""",
    "map_layer": f"""SELECT zone_id, zone_name, {fix('centroid_lat')} AS latitude, {fix('centroid_lon')} AS longitude, total_violations,
      parking_related_violations, {_fixes('hotspot_score peak_share')}, hotspot_band, top_police_station, top_location, dominant_time_bucket,
      {big('dominant_hour')} AS dominant_hour, {fix('greatest(5.0, least(25.0, sqrt(total_violations)*0.3))')} AS marker_radius,
      replace(lower(hotspot_band),' ','-') AS band_style, CASE hotspot_band WHEN 'Very High' THEN '#ef4444' WHEN 'High' THEN '#f97316'
      WHEN 'Medium' THEN '#eab308' WHEN 'Low' THEN '#22c55e' ELSE '#64748b' END AS band_colour FROM zones""",
    "map_filtered": """SELECT zone_id, hotspot_band, dominant_time_bucket FROM zones
      WHERE hotspot_band='Medium' AND dominant_time_bucket='night'""",
    "map_popup": f"""SELECT z.zone_id, z.zone_name, {fix('greatest(5.0, least(25.0, sqrt(total_violations)*0.3))')} AS marker_radius,
      {_fixes('predicted_next_day_violations predicted_risk_score')}, predicted_risk_band, recommended_action,
      {big('manpower_estimate')} AS manpower_estimate, time_window_to_watch FROM zones z LEFT JOIN recs r ON r.zone_id=z.zone_id""",
    "stations": "SELECT DISTINCT top_police_station FROM zones WHERE top_police_station<>''",
    "zone_inspector": f"""SELECT e.zone_id, coalesce(r.zone_name, z.zone_name, '—') AS zone_name,
      coalesce(r.top_police_station, z.top_police_station, '—') AS police_station, {_fixes('actual predicted absolute_error')},
      CASE WHEN manpower_estimate>0 THEN CAST(manpower_estimate AS VARCHAR) ELSE '0 officers' END AS manpower,
      coalesce(time_window_to_watch,'—') AS watch_window FROM err e LEFT JOIN recs r ON r.zone_id=e.zone_id LEFT JOIN zones z ON z.zone_id=e.zone_id""",
    "sorted_by_text_number": """SELECT entity_name, CAST(total_violations AS VARCHAR) AS total_text, global_rank,
      row_number() OVER (ORDER BY total_violations DESC, CAST(total_violations AS VARCHAR) DESC, global_rank)-1 AS position FROM ent""",
    "panel_appended": f"""SELECT strftime(created_date,'%Y-%m') AS panel_month, count(*) AS n, {big('sum(daily_violation_count)')} AS daily_violation_count,
      {big('sum(rolling_14d_sum)')} AS rolling_14d_sum, {big('sum(days_since_last_violation)')} AS days_since_last_violation,
      {fix('sum(count_growth_rate_14d)')} AS count_growth_rate_14d, {big('sum(next_day_violation_count)')} AS next_day_violation_count FROM feat GROUP BY 1""",
    "csv_rejects": """SELECT CASE id%50 WHEN 1 THEN 'columns' WHEN 2 THEN 'date' WHEN 3 THEN 'field' ELSE 'accepted' END AS reason, count(*) AS n FROM rec GROUP BY 1
      UNION ALL SELECT 'input', count(*) FROM rec""",
    "ordered_marts": f"""SELECT 'zones' AS mart, zone_id, row_number() OVER (ORDER BY hotspot_score DESC, total_violations DESC, zone_id)-1 AS position
      FROM zones UNION ALL SELECT 'recommendations', zone_id, row_number() OVER (ORDER BY {RISK_ORDER})-1 FROM recs""",
    "top_allocations": f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY {RISK_ORDER}) AS place, zone_id, string_split(zone_name,' / ')[1] AS short_name,
      predicted_risk_band, {_bigs('officers_assigned')}, CASE WHEN trucks_assigned>0 THEN 1::BIGINT ELSE 0::BIGINT END AS towed,
      {big('floor(officers_assigned/req*100+0.5)')} AS coverage_pct FROM alloc WHERE officers_assigned>0) WHERE place<=6""",
    "saturated_fits": "SELECT day_of_week, count(*) AS n, " + ", ".join(
        f"{fix('avg(daily_violation_count)')} AS {m}" for m in ("poisson", "tweedie", "extra_trees", "forest", "boosted")
    ) + " FROM feat GROUP BY day_of_week",
    "blend_search": f"""SELECT trial, 0::BIGINT AS rounds, folds, {fix('score')} AS score,
      row_number() OVER (ORDER BY folds DESC, score DESC, trial) AS place FROM (
      SELECT trial, CASE WHEN r2<=13 THEN 3 WHEN r1<=25 THEN 2 ELSE 1 END::BIGINT AS folds, round(CASE WHEN r2<=13 THEN (p1+p2+p3)/3
        WHEN r1<=25 THEN (p1+p2)/2 ELSE p1 END*1e9)/1e9 AS score FROM (
      SELECT *, CASE WHEN r1<=25 THEN row_number() OVER (ORDER BY r1<=25 DESC, round((p1+p2)/2*1e9)/1e9 DESC, trial) END AS r2 FROM (
      SELECT *, row_number() OVER (ORDER BY round(p1*1e9)/1e9 DESC, trial) AS r1 FROM (
      SELECT trial, max(p) FILTER (block=1) AS p1, max(p) FILTER (block=2) AS p2, max(p) FILTER (block=3) AS p3 FROM (
      SELECT trial, block, coalesce(CAST(sum(hits) AS DOUBLE)/(10*count(hits)),0) AS p FROM (
      SELECT trial, block, created_date, CASE WHEN count(*)>=10 AND max(y)<>0 THEN sum(CASE WHEN ry<=10 AND rp<=10 THEN 1 ELSE 0 END) END AS hits FROM (
      SELECT *, row_number() OVER (PARTITION BY trial, created_date ORDER BY y DESC, zone_id DESC) AS ry,
        row_number() OVER (PARTITION BY trial, created_date ORDER BY yhat DESC, zone_id DESC) AS rp FROM (
      SELECT t.i AS trial, b.block, m.created_date, m.zone_id, CAST(m.next_day_violation_count AS DOUBLE) AS y,
        t.i/49e0*m.lag_1_count+(1e0-t.i/49e0)*m.rolling_7d_mean AS yhat FROM modl m JOIN (
        SELECT created_date, CASE WHEN a<n-3*(n//4) THEN 0 ELSE (a-(n-3*(n//4)))//(n//4)+1 END AS block FROM (
          SELECT created_date, row_number() OVER (ORDER BY created_date)-1 AS a, count(*) OVER () AS n FROM spd WHERE split='train')) b
        ON b.created_date=m.created_date, range(50) t(i) WHERE b.block>0))
      GROUP BY 1,2,3) GROUP BY 1,2) GROUP BY 1))))""",
    "attribution_fixed_tree": f"""SELECT zone_id, created_date, {fix('e0')} AS base, {fix('(el-e0+ef-em)/2')} AS lag_part, {fix('(em-e0+ef-el)/2')} AS mean_part,
      {fix('ef')} AS output FROM (SELECT zone_id, created_date, (na*va+nb*vb+nc*vc+nd*vd)/(na+nb+nc+nd) AS e0,
      CASE WHEN lag<=l THEN (na*va+nb*vb)/(na+nb) WHEN lag<=2*l THEN vc ELSE vd END AS el,
      (na+nb)/(na+nb+nc+nd)*CASE WHEN mean<=m THEN va ELSE vb END+(nc*vc+nd*vd)/(na+nb+nc+nd) AS em,
      CASE WHEN lag<=l THEN CASE WHEN mean<=m THEN va ELSE vb END WHEN lag<=2*l THEN vc ELSE vd END AS ef
      FROM (SELECT *, CAST(count(*) FILTER (lag<=l AND mean<=m) OVER () AS DOUBLE) AS na, coalesce(avg(y) FILTER (lag<=l AND mean<=m) OVER (),0) AS va,
        CAST(count(*) FILTER (lag<=l AND mean>m) OVER () AS DOUBLE) AS nb, coalesce(avg(y) FILTER (lag<=l AND mean>m) OVER (),0) AS vb,
        CAST(count(*) FILTER (lag>l AND lag<=2*l) OVER () AS DOUBLE) AS nc, coalesce(avg(y) FILTER (lag>l AND lag<=2*l) OVER (),0) AS vc,
        CAST(count(*) FILTER (lag>2*l) OVER () AS DOUBLE) AS nd, coalesce(avg(y) FILTER (lag>2*l) OVER (),0) AS vd
      FROM (SELECT *, avg(lag) OVER () AS l, floor(avg(mean) OVER ()*1e6)/1e6 AS m FROM (
        SELECT f.zone_id, f.created_date, CAST(lag_1_count AS DOUBLE) AS lag, rolling_7d_mean AS mean, CAST(next_day_violation_count AS DOUBLE) AS y
        FROM modl f JOIN spd s ON s.created_date=f.created_date WHERE s.split='train'))))""",
    "importance_shares": f"""SELECT feature, model_name, {_fixes('importance average')}, {_DESCRIBED} AS description FROM ({_SHARES})""",
    "top_features": f"""SELECT feature, {fix('average')} AS average, place, {big('place<=10')} AS in_10, {big('place<=5')} AS in_5 FROM ({_TOP}) WHERE place<=15""",
    "leading_shares": f"""SELECT model_name, arg_max(feature, (importance, feature)) AS leading_feature FROM ({_SHARES})
      WHERE feature IN (SELECT feature FROM ({_TOP}) WHERE place<=10) GROUP BY 1""",
}


def oracle_sql() -> dict[str, str]:
    return {name: compose(select) for name, select in SELECTS.items()}
