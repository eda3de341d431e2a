"""Named SQL fragments; `compose` turns a SELECT over them into one statement with the CTEs it needs."""

from __future__ import annotations

import re

from zonecast.sources.records import RECORDS_SQL


def fix(x: str) -> str:
    """Twin of `plans.catalog.fixed`: six digits, with the cut placed off the half so that sums in any order agree."""
    return f"floor(({x})*1e6 + 0.5001)/1e6"


def half_even(x: str, d: int) -> str:
    return f"round_even(({x})*1e{d}, 0)/1e{d}"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def haversine(a: str, b: str, c: str, d: str) -> str:
    return (
        f"12742000.0*asin(sqrt(pow(sin(radians({c}-{a})/2),2)"
        f"+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2)))"
    )


MONTHS = ["november", "december", "january", "february", "march", "april"]
_MONTH_COLS = [f"violations_{m[:3]}" for m in MONTHS]
_SLOPE = "+".join(f"{c}*({i - 2.5})" for i, c in enumerate(_MONTH_COLS))
_ACTIVE = "+".join(f"CAST({c}>0 AS INT)" for c in _MONTH_COLS)
SCORE = "0.35*n_total+0.25*n_parking+0.20*n_peak+0.10*n_recency+0.10*n_loc"


def norm(col: str, name: str, over: str = "") -> str:
    low, high = f"min(ln(1+{col})) OVER ({over})", f"max(ln(1+{col})) OVER ({over})"
    return f"CASE WHEN {high}>{low} THEN (ln(1+{col})-{low})/({high}-{low}) ELSE 0 END AS {name}"


def mode(field: str, name: str, default: str, where: str = "TRUE", table: str = "lab") -> str:
    return f"""{name} AS (SELECT zone_id, v AS {field} FROM (SELECT zone_id, {field} AS v,
      row_number() OVER (PARTITION BY zone_id ORDER BY count(*) DESC, {field}) AS r FROM {table}
      WHERE {field} IS NOT NULL AND {where} GROUP BY zone_id, {field}) WHERE r=1)"""


def mode_sub(field: str, where: str = "TRUE") -> str:
    return f"""SELECT zone_id, v FROM (SELECT zone_id, {field} AS v, row_number() OVER (PARTITION BY zone_id
      ORDER BY count(*) DESC, {field}) AS r FROM lab WHERE zone_id<>'ZONE_NOISE' AND {field} IS NOT NULL AND {where}
      GROUP BY zone_id, {field}) WHERE r=1"""


W = "PARTITION BY zone_id ORDER BY created_date"


def _full(fn: str, col: str, n: int) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({col}) {frame}={n} THEN {fn}({col}) {frame} END"


STATIC = (
    "zone_name centroid_lat centroid_lon lat_std lon_std violation_density unique_violation_types "
    "unique_vehicle_classes unique_locations unique_junctions recurring_hotspot_flag month_over_month_trend "
    "peak_share hotspot_band top_police_station top_junction top_location dominant_time_bucket"
).split()
ZONE_NAME = """CASE WHEN top_junction='No Junction' THEN concat(seg,' / ',top_police_station,' Zone')
  WHEN contains(lower(sj), lower(seg)) THEN concat(sj,' / ',top_police_station,' Zone')
  ELSE concat(seg,' / ',sj,' Zone') END"""


def short_junction(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^BTP\d+\s*-\s*', ''), '\s+Junction$', '')"


def band(p: str) -> str:
    return f"CASE WHEN {p}<=0.1 THEN 'Very High' WHEN {p}<=0.3 THEN 'High' WHEN {p}<=0.6 THEN 'Medium' ELSE 'Low' END"


FRAGMENTS: dict[str, str] = {
    "rec0": RECORDS_SQL.format(events="events"),
    "rec": """SELECT *, CASE WHEN created_hour>=8 AND created_hour<11 THEN 'morning_peak'
        WHEN created_hour>=11 AND created_hour<17 THEN 'midday'
        WHEN created_hour>=17 AND created_hour<20 THEN 'evening_peak' ELSE 'night' END AS time_bucket,
      CASE WHEN created_hour>=8 AND created_hour<11 THEN 1 ELSE 0 END AS is_morning_peak,
      CASE WHEN created_hour>=17 AND created_hour<20 THEN 1 ELSE 0 END AS is_evening_peak,
      CASE WHEN created_hour BETWEEN 8 AND 10 OR created_hour BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_peak_hour,
      CAST(isodow(created_date)-1 AS BIGINT) AS created_day_of_week, dayname(created_date) AS created_day_name,
      CASE WHEN isodow(created_date)>=6 THEN 1 ELSE 0 END AS is_weekend, monthname(created_date) AS created_month_name,
      concat(CAST(floor(latitude*1000+0.5) AS BIGINT),'_',CAST(floor(longitude*1000+0.5) AS BIGINT)) AS geo_cell,
      exp(-0.0231*(max(days_since_start) OVER () - days_since_start)) AS recency_weight FROM rec0""",
    "pts": """SELECT latitude AS lat, longitude AS lon, count(*) AS w,
      row_number() OVER (ORDER BY latitude, longitude) AS pid FROM rec GROUP BY 1,2""",
    "prs": f"""SELECT a.pid AS u, b.pid AS v, b.w AS w FROM pts a JOIN pts b
      ON b.lat BETWEEN a.lat-0.001 AND a.lat+0.001 AND b.lon BETWEEN a.lon-0.0012 AND a.lon+0.0012
      WHERE {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 100""",
    "core": "SELECT u AS pid FROM prs GROUP BY u HAVING sum(w)>=10",
    "ce": "SELECT u, v FROM prs WHERE u IN (SELECT pid FROM core) AND v IN (SELECT pid FROM core)",
    "reach": "SELECT pid AS u, pid AS v FROM core UNION SELECT r.u, e.v FROM reach r JOIN ce e ON e.u=r.v",
    "comp": "SELECT v AS pid, min(u) AS c FROM reach GROUP BY v",
    "plab": """SELECT p.pid, p.lat, p.lon, p.w, coalesce(c.c, b.c) AS c, c.c IS NOT NULL AS is_core FROM pts p
      LEFT JOIN comp c ON c.pid=p.pid
      LEFT JOIN (SELECT r.u AS pid, min(k.c) AS c FROM prs r JOIN comp k ON k.pid=r.v GROUP BY r.u) b ON b.pid=p.pid""",
    "zid": """SELECT c, records, CASE WHEN r<1000 THEN concat('ZONE_', lpad(CAST(r AS VARCHAR),3,'0'))
      ELSE concat('ZONE_', r) END AS zone_id FROM (SELECT c, CAST(sum(w) AS BIGINT) AS records,
      row_number() OVER (ORDER BY sum(w) DESC, c) AS r FROM plab WHERE c IS NOT NULL GROUP BY c)""",
    "lab": """SELECT rec.*, coalesce(z.zone_id,'ZONE_NOISE') AS zone_id FROM rec
      JOIN plab p ON p.lat=rec.latitude AND p.lon=rec.longitude LEFT JOIN zid z ON z.c=p.c""",
    "ztot": f"""SELECT zone_id, avg(latitude) AS centroid_lat, avg(longitude) AS centroid_lon,
      coalesce(stddev_samp(latitude),0) AS lat_std, coalesce(stddev_samp(longitude),0) AS lon_std,
      min(latitude) AS lat_lo, max(latitude) AS lat_hi, min(longitude) AS lon_lo, max(longitude) AS lon_hi,
      count(*) AS total_violations, {big('sum(parking_related_violation_count)')} AS parking_related_violations,
      {big('sum(non_parking_violation_count)')} AS non_parking_violations, {big('sum(is_peak_hour)')} AS peak_hour_violations,
      {big('sum(is_morning_peak)')} AS morning_peak_violations, {big('sum(is_evening_peak)')} AS evening_peak_violations,
      {big('sum(is_weekend)')} AS weekend_violations, {big('sum(1-is_weekend)')} AS weekday_violations,
      count(*) FILTER (time_bucket='night') AS night_violations, sum(recency_weight) AS recency_weight_sum,
      {', '.join(f"count(*) FILTER (lower(created_month_name)='{m}') AS {c}" for m, c in zip(MONTHS, _MONTH_COLS))},
      count(DISTINCT primary_violation) AS unique_violation_types, count(DISTINCT vehicle_class) AS unique_vehicle_classes,
      count(DISTINCT location_clean) AS unique_locations, count(DISTINCT junction_name_clean) AS unique_junctions
      FROM lab WHERE zone_id<>'ZONE_NOISE' GROUP BY zone_id""",
    "zmode": f"""SELECT t.zone_id, coalesce(a.v,'Unknown Station') AS top_police_station, coalesce(b.v,'No Junction') AS top_junction,
      coalesce(c.v,'Unknown Street') AS top_location, coalesce(d.v,'Unknown Street') AS seg, coalesce(e.v,12) AS dominant_hour,
      coalesce(f.v,'midday') AS dominant_time_bucket, coalesce(g.v,'Monday') AS dominant_day_name FROM ztot t
      LEFT JOIN ({mode_sub('police_station_clean')}) a ON a.zone_id=t.zone_id
      LEFT JOIN ({mode_sub('junction_name_clean', "junction_name_clean<>'No Junction'")}) b ON b.zone_id=t.zone_id
      LEFT JOIN ({mode_sub('location_clean')}) c ON c.zone_id=t.zone_id
      LEFT JOIN ({mode_sub('location_first_segment')}) d ON d.zone_id=t.zone_id
      LEFT JOIN ({mode_sub('created_hour')}) e ON e.zone_id=t.zone_id
      LEFT JOIN ({mode_sub('time_bucket')}) f ON f.zone_id=t.zone_id
      LEFT JOIN ({mode_sub('created_day_name')}) g ON g.zone_id=t.zone_id""",
    "zgeo": f"""SELECT *, greatest({haversine('centroid_lat', 'lon_lo', 'centroid_lat', 'lon_hi')}
      * {haversine('lat_lo', 'centroid_lon', 'lat_hi', 'centroid_lon')}, 100.0) AS area_m2 FROM ztot""",
    "zrow": f"""SELECT g.*, m.* EXCLUDE (zone_id), {half_even('total_violations/area_m2', 6)} AS violation_density,
      {half_even(f'({_SLOPE})/17.5/(total_violations/6.0)', 4)} AS month_over_month_trend,
      CASE WHEN {_ACTIVE}>=3 AND total_violations>=15 THEN 1 ELSE 0 END AS recurring_hotspot_flag,
      {half_even('peak_hour_violations/total_violations', 4)} AS peak_share,
      {short_junction('top_junction')} AS sj FROM zgeo g JOIN zmode m ON m.zone_id=g.zone_id""",
    "zscore": f"""SELECT *, {half_even(f'({SCORE})*100', 2)} AS hotspot_score, {ZONE_NAME} AS zone_name FROM (
      SELECT *, {norm('total_violations', 'n_total')}, {norm('parking_related_violations', 'n_parking')},
      {norm('peak_hour_violations', 'n_peak')}, {norm('recency_weight_sum', 'n_recency')},
      {norm('unique_locations', 'n_loc')} FROM zrow)""",
    "zones": f"""SELECT *, {band('(ord-1)/nz')} AS hotspot_band FROM (SELECT *,
      row_number() OVER (ORDER BY hotspot_score DESC, total_violations DESC, zone_id) AS ord, count(*) OVER () AS nz FROM zscore)""",
    "ent0": f"""SELECT t AS entity_type, raw AS raw_name, count(*) AS total_violations,
      {big('sum(parking_related_violation_count)')} AS parking_related_violations, {big('sum(is_peak_hour)')} AS peak_hour_violations,
      sum(recency_weight) AS recency_weight_sum, count(DISTINCT location_clean) AS location_diversity FROM (
        SELECT 'Police Station' AS t, police_station_clean AS raw, rec.* FROM rec
        UNION ALL SELECT 'Junction', junction_name_clean, rec.* FROM rec
        UNION ALL SELECT 'Street/Location', location_first_segment, rec.* FROM rec)
      WHERE raw IS NOT NULL AND trim(raw)<>'' AND lower(raw) NOT IN ('unknown','no junction') GROUP BY t, raw""",
    "ent": f"""SELECT *, row_number() OVER (ORDER BY hotspot_score DESC, total_violations DESC, entity_type, raw_name) AS global_rank,
      row_number() OVER (PARTITION BY entity_type ORDER BY hotspot_score DESC, total_violations DESC, raw_name) AS entity_rank,
      CASE WHEN entity_type='Junction' THEN {short_junction('raw_name')} ELSE raw_name END AS entity_name
      FROM (SELECT *, {half_even(f'({SCORE})*100', 2)} AS hotspot_score FROM (SELECT *,
        {norm('total_violations', 'n_total', 'PARTITION BY entity_type')}, {norm('parking_related_violations', 'n_parking', 'PARTITION BY entity_type')},
        {norm('peak_hour_violations', 'n_peak', 'PARTITION BY entity_type')}, {norm('recency_weight_sum', 'n_recency', 'PARTITION BY entity_type')},
        {norm('location_diversity', 'n_loc', 'PARTITION BY entity_type')} FROM ent0))""",
    "heat": """SELECT d AS day_of_week, CASE d WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday'
      WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' ELSE 'Sunday' END AS day_name, h AS hour,
      coalesce(n,0) AS violation_count FROM range(7) a(d), range(24) b(h) LEFT JOIN (SELECT created_day_of_week AS cd,
      created_hour AS ch, count(*) AS n FROM rec GROUP BY 1,2) ON cd=d AND ch=h""",
    "panel": f"""SELECT z.zone_id, d.created_date, coalesce(c.n,0) AS daily_violation_count,
      coalesce(c.p,0) AS daily_parking_violation_count, coalesce(c.k,0) AS daily_peak_hour_count,
      row_number() OVER (PARTITION BY z.zone_id ORDER BY d.created_date)-1 AS ix
      FROM (SELECT DISTINCT zone_id FROM lab WHERE zone_id<>'ZONE_NOISE') z, (SELECT DISTINCT created_date FROM lab) d
      LEFT JOIN (SELECT zone_id AS cz, created_date AS cd, count(id) AS n, {big('sum(parking_related_violation_count)')} AS p,
        {big('sum(is_peak_hour)')} AS k FROM lab GROUP BY 1,2) c ON c.cz=z.zone_id AND c.cd=d.created_date""",
    "pw": f"""SELECT *, lag(daily_violation_count,1) OVER ({W}) AS lag_1_count, lag(daily_violation_count,3) OVER ({W}) AS lag_3_count,
      lag(daily_violation_count,7) OVER ({W}) AS lag_7_count, lag(daily_violation_count,14) OVER ({W}) AS lag_14_count,
      lag(daily_parking_violation_count,1) OVER ({W}) AS lag_1_parking_count,
      lag(daily_peak_hour_count,1) OVER ({W}) AS lag_1_peak_hour_count,
      {big(_full('sum', 'daily_violation_count', 7))} AS rolling_7d_sum, {_full('avg', 'daily_violation_count', 7)} AS rolling_7d_mean,
      {big(_full('sum', 'daily_violation_count', 14))} AS rolling_14d_sum, {_full('avg', 'daily_violation_count', 14)} AS rolling_14d_mean,
      {big(_full('sum', 'daily_parking_violation_count', 7))} AS rolling_7d_parking_sum,
      {big(_full('sum', 'daily_peak_hour_count', 7))} AS rolling_7d_peak_hour_sum,
      coalesce(ix-max(CASE WHEN daily_violation_count>0 THEN ix END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),90)
        AS days_since_last_violation,
      lead(daily_violation_count,1) OVER ({W}) AS next_day_violation_count,
      CAST(isodow(created_date)-1 AS BIGINT) AS day_of_week, CASE WHEN isodow(created_date)>=6 THEN 1 ELSE 0 END AS is_weekend,
      CAST(month(created_date) AS BIGINT) AS month, CAST((day(created_date)-1)//7+1 AS BIGINT) AS week_of_month,
      CASE WHEN month(created_date) IN (11,12,1) THEN 1 ELSE 0 END AS is_peak_season FROM panel""",
    "pg": f"""SELECT *, (rolling_7d_mean-b7)/(b7+1e-5) AS count_growth_rate_7d, (rolling_14d_mean-b14)/(b14+1e-5) AS count_growth_rate_14d
      FROM (SELECT *, lag(rolling_7d_mean,7) OVER ({W}) AS b7, lag(rolling_14d_mean,14) OVER ({W}) AS b14 FROM pw)""",
    "feat": f"""SELECT pg.*, {', '.join(f'z.{c}' for c in STATIC)}, CASE z.hotspot_band WHEN 'Very High' THEN 4 WHEN 'High' THEN 3
      WHEN 'Medium' THEN 2 ELSE 1 END AS hotspot_band_num FROM pg LEFT JOIN zones z ON z.zone_id=pg.zone_id""",
    "modl": """SELECT * FROM feat WHERE next_day_violation_count IS NOT NULL AND lag_14_count IS NOT NULL
      AND rolling_14d_mean IS NOT NULL AND count_growth_rate_14d IS NOT NULL""",
    "spd": """SELECT created_date, CASE WHEN r<=floor(n*0.75) THEN 'train' WHEN r<=floor(n*0.875) THEN 'val' ELSE 'test' END AS split
      FROM (SELECT created_date, row_number() OVER (ORDER BY created_date) AS r, count(*) OVER () AS n
      FROM (SELECT DISTINCT created_date FROM modl))""",
    "base": """SELECT m.model_name, s.split, f.zone_id, f.created_date, CAST(f.next_day_violation_count AS DOUBLE) AS y,
      CASE WHEN m.model_name='Rolling 7d Mean' THEN f.rolling_7d_mean ELSE CAST(f.lag_1_count AS DOUBLE) END AS yhat
      FROM modl f JOIN spd s ON s.created_date=f.created_date, (VALUES ('Persistence (lag_1)'),('Rolling 7d Mean')) m(model_name)
      WHERE s.split<>'train'""",
    "wts": """SELECT model_name, (1/mae)/sum(1/mae) OVER () AS weight FROM (SELECT model_name, avg(abs(yhat-y)) AS mae
      FROM base WHERE split='val' GROUP BY 1)""",
    "preds": """SELECT model_name, split, zone_id, created_date, y, yhat FROM base
      UNION ALL SELECT 'Ensemble (Simple Avg)', split, zone_id, created_date, max(y), avg(yhat) FROM base GROUP BY 2,3,4
      UNION ALL SELECT 'Ensemble (Weighted Avg)', split, zone_id, created_date, max(y), sum(weight*yhat) FROM base
        JOIN wts USING (model_name) GROUP BY 2,3,4""",
    "pday": """SELECT model_name, split, created_date, CASE WHEN count(*)>=10 AND max(y)<>0
      THEN sum(CASE WHEN ry<=10 AND rp<=10 THEN 1 ELSE 0 END) END AS hits FROM (SELECT *,
      row_number() OVER (PARTITION BY model_name, split, created_date ORDER BY y DESC, zone_id DESC) AS ry,
      row_number() OVER (PARTITION BY model_name, split, created_date ORDER BY yhat DESC, zone_id DESC) AS rp FROM preds)
      GROUP BY 1,2,3""",
    "met": """SELECT a.*, coalesce(p10,0) AS p10 FROM (SELECT model_name, split, avg(abs(yhat-y)) AS mae,
      sqrt(avg((yhat-y)*(yhat-y))) AS rmse FROM preds GROUP BY 1,2) a
      JOIN (SELECT model_name, split, CAST(sum(hits) AS DOUBLE)/(10*count(hits)) AS p10 FROM pday GROUP BY 1,2) b USING (model_name, split)""",
    "board": "SELECT model_name, 'raw' AS variant, " + ", ".join(
        half_even(f"max(CASE WHEN split='{s}' THEN {m} END)", 4) + f" AS {s}_{m}"
        for s in ("val", "test") for m in ("mae", "rmse", "p10")
    ) + " FROM met GROUP BY model_name",
    "best": "SELECT * FROM board ORDER BY val_p10 DESC, model_name LIMIT 1",
    "err": """SELECT *, abs(error) AS absolute_error FROM (SELECT zone_id, avg(y) AS actual, avg(yhat) AS predicted,
      avg(yhat)-avg(y) AS error FROM preds WHERE split='test' AND model_name=(SELECT model_name FROM best) GROUP BY zone_id)""",
    "lastday": "SELECT * FROM feat WHERE created_date=(SELECT max(created_date) FROM feat)",
}
RISK_BAND = "CASE WHEN pct>=0.9 THEN 'Very High' WHEN pct>=0.7 THEN 'High' WHEN pct>=0.4 THEN 'Medium' ELSE 'Low' END"


def _risk(source: str) -> str:
    return f"""SELECT *, CASE WHEN up AND hotspot_band='Very High' THEN greatest(score0, 90.0)
        WHEN up AND hotspot_band='High' AND band0 IN ('Medium','Low') THEN greatest(score0, 70.0) ELSE score0 END AS predicted_risk_score,
      CASE WHEN up AND hotspot_band='Very High' THEN 'Very High'
        WHEN up AND hotspot_band='High' AND band0 IN ('Medium','Low') THEN 'High' ELSE band0 END AS predicted_risk_band
      FROM (SELECT *, {half_even('pct*100', 1)} AS score0, {RISK_BAND} AS band0, p>lag_1_count AS up
      FROM (SELECT *, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p)-1)/2.0)/count(*) OVER () AS pct
      FROM (SELECT *, {half_even(f'greatest(CAST({source} AS DOUBLE),0.0)', 2)} AS p FROM lastday)))"""


FRAGMENTS["risk"] = _risk("rolling_7d_mean")
FRAGMENTS["risk_old"] = _risk("lag_1_count")
FRAGMENTS["recs"] = """SELECT zone_id, zone_name, top_police_station, top_junction, top_location,
      p AS predicted_next_day_violations, predicted_risk_score, predicted_risk_band,
      CASE predicted_risk_band WHEN 'Very High' THEN 'Deploy Towing Vehicle + 3 Officers + Barricade Support'
        WHEN 'High' THEN 'Deploy 2 Officers + Active Patrol Monitoring'
        WHEN 'Medium' THEN 'Deploy 1 Officer / Mobile Patrol (Warning & Monitoring)' ELSE 'No Dedicated Deployment' END AS recommended_action,
      CASE predicted_risk_band WHEN 'Very High' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END AS manpower_estimate,
      CASE dominant_time_bucket WHEN 'morning_peak' THEN '08:00 AM - 11:00 AM (Morning Peak Focus)'
        WHEN 'evening_peak' THEN '05:00 PM - 08:00 PM (Evening Peak Focus)' WHEN 'midday' THEN '11:00 AM - 05:00 PM (Midday Traffic Focus)'
        WHEN 'night' THEN '08:00 PM - 08:00 AM (Night Monitoring Focus)' ELSE '08:00 AM - 08:00 PM' END AS time_window_to_watch FROM risk"""
RISK_ORDER = "predicted_risk_score DESC, predicted_next_day_violations DESC, zone_id"
FRAGMENTS["alloc"] = f"""SELECT *, greatest(0, least(req, 20-used)) AS officers_assigned,
      CASE WHEN tow>0 AND asked<2 AND greatest(0, least(req, 20-used))>0 THEN 1 ELSE 0 END AS trucks_assigned FROM (
      SELECT *, coalesce(sum(req) OVER (ORDER BY {RISK_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS used,
      coalesce(sum(tow) OVER (ORDER BY {RISK_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS asked FROM (
      SELECT *, manpower_estimate AS req, CASE WHEN predicted_risk_band='Very High' THEN 1 ELSE 0 END AS tow FROM recs))"""
FRAGMENTS["imp"] = """SELECT *, CAST(greatest(5, least(85, floor(impact_score*0.7 + CASE WHEN total_violations>12000 THEN 12 ELSE 0 END + 0.5))) AS BIGINT)
      AS capacity_loss FROM (SELECT *, floor((violation_density/CASE WHEN md=0 THEN 1 ELSE md END*100*0.30 + peak_share*100*0.25
      + CASE WHEN top_junction<>'No Junction' THEN 100 ELSE 30 END*0.20
      + CASE WHEN regexp_matches(zone_name,'(?i)(ring\\s*road|main\\s*road|highway|expressway|junction)') THEN 100
        WHEN regexp_matches(zone_name,'(?i)(flyover|underpass|bridge|cross)') THEN 80 ELSE 40 END*0.15
      + least(100.0, unique_vehicle_classes/CASE WHEN mc=0 THEN 1 ELSE mc END*100)*0.10)*10 + 0.5)/10 AS impact_score
      FROM (SELECT *, max(violation_density) OVER () AS md, max(unique_vehicle_classes) OVER () AS mc FROM zones))"""
_ORDER = list(FRAGMENTS)


def compose(select: str) -> str:
    """`select` preceded by the fragments it refers to, directly or through others."""
    needed: set[str] = set()
    todo = [select]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in words & FRAGMENTS.keys() - needed:
            needed.add(name)
            todo.append(FRAGMENTS[name])
    if not needed:
        return select
    parts = [
        f"reach(u, v) AS ({FRAGMENTS[n]})" if n == "reach" else f"{n} AS MATERIALIZED ({FRAGMENTS[n]})"
        for n in _ORDER if n in needed
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
