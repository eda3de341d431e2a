"""Panel, ranking, allocation and evaluation against plain pandas or hand-made tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from zonecast.functions import scalars as S
from zonecast.operators import deployment, evaluation, panel
from zonecast.operators.ordering import average_rank, bounded_position, running_total, with_position
from zonecast.operators.scoring import band_by_position, log_minmax

DAY0 = dt.date(2023, 11, 10)


def random_daily(seed, zones=4, n=40, gap=None):
    rng = np.random.default_rng(seed)
    rows = []
    for z in range(zones):
        for d in range(n):
            if d != gap and rng.random() < 0.6:
                c = int(rng.integers(1, 6))
                rows.append((f"Z{z}", DAY0 + dt.timedelta(days=d), c, c // 2, c % 2))
    return rows


@pytest.mark.parametrize("gap", [None, 9])
def test_window_features_match_pandas(spark, gap):
    rows = random_daily(1, gap=gap)
    daily = spark.createDataFrame(rows, "zone_id string, created_date date, daily_violation_count long, "
                                        "daily_parking_violation_count long, daily_peak_hour_count long")
    got = panel.time_features(panel.dense_panel(daily, panel.observed_dates(daily))).toPandas()
    got = got.sort_values(["zone_id", "created_date"]).reset_index(drop=True)
    dates = sorted({r[1] for r in rows})
    assert len(got) == 4 * len(dates)
    base = pd.DataFrame(rows, columns=["zone_id", "created_date", "c", "p", "k"])
    want = pd.MultiIndex.from_product([sorted(base.zone_id.unique()), dates], names=["zone_id", "created_date"]).to_frame(index=False)
    want = want.merge(base, how="left").fillna(0)
    for _, g in want.groupby("zone_id"):
        out = got.loc[g.index]
        c, prev = g.c, g.c.shift(1)
        for k in (1, 3, 7, 14):
            np.testing.assert_allclose(out[f"lag_{k}_count"].astype(float), c.shift(k))
        for n in (7, 14):
            mean = prev.rolling(n).mean()
            np.testing.assert_allclose(out[f"rolling_{n}d_sum"].astype(float), prev.rolling(n).sum())
            np.testing.assert_allclose(out[f"rolling_{n}d_mean"].astype(float), mean)
            np.testing.assert_allclose(out[f"count_growth_rate_{n}d"].astype(float), (mean - mean.shift(n)) / (mean.shift(n) + 1e-5))
        np.testing.assert_allclose(out.rolling_7d_parking_sum.astype(float), g.p.shift(1).rolling(7).sum())
        np.testing.assert_allclose(out.next_day_violation_count.astype(float), c.shift(-1))
        since, last = [], None
        for i, v in enumerate(c):
            since.append(90 if last is None else i - last)
            last = i if v > 0 else last
        assert list(out.days_since_last_violation) == since


def test_features_do_not_see_the_present(spark):
    rows = random_daily(2, zones=2, n=30)
    schema = "zone_id string, created_date date, daily_violation_count long, daily_parking_violation_count long, daily_peak_hour_count long"
    cut = DAY0 + dt.timedelta(days=20)
    changed = [(z, d, c * (7 if d >= cut else 1), p, k) for z, d, c, p, k in rows]
    frames = []
    for data in (rows, changed):
        df = spark.createDataFrame(data, schema)
        full = panel.time_features(panel.dense_panel(df, panel.observed_dates(df))).filter(F.col("created_date") <= cut)
        frames.append(sorted(map(tuple, full.drop(*panel.COUNTS, panel.TARGET).collect()), key=str))
    assert frames[0] == frames[1]


def test_panel_plan_has_one_exchange_per_input(spark, tmp_path):
    rows = random_daily(3)
    path = str(tmp_path / "daily")
    spark.createDataFrame(rows, "zone_id string, created_date date, daily_violation_count long, "
                                "daily_parking_violation_count long, daily_peak_hour_count long").write.parquet(path)
    daily = spark.read.parquet(path)
    dates = [r[0] for r in daily.select("created_date").distinct().collect()]
    literal = F.array(*[F.lit(d) for d in sorted(dates)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = panel.time_features(panel.dense_panel(daily, literal))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    initial = plan.split("== Initial Plan ==")[-1]
    assert "Cartesian" not in initial and "NestedLoop" not in initial
    assert initial.count("Exchange hashpartitioning") == 2  # zone list and daily counts, none for the windows


def test_dense_panel_takes_as_many_parts_as_its_rows_need(spark, monkeypatch):
    monkeypatch.setattr(panel, "TASK_ROWS", 100)
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(40)]
    daily = spark.createDataFrame([(f"z{i}", days[i], 1, 1, 0) for i in range(40)], ["zone_id", "created_date", *panel.COUNTS])
    dense = panel.time_features(panel.dense_panel(daily, panel.observed_dates(daily)))
    assert dense.rdd.getNumPartitions() == 16 and dense.count() == 1600


def keyed(rows, schema, spark):
    return spark.createDataFrame(rows, schema)


def test_positions_small_and_large_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = keyed([(i, float(rng.integers(0, 7))) for i in range(300)], "id long, v double", spark)
    order = [F.desc("v"), F.asc("id")]
    small = bounded_position(df, order).collect()
    large = with_position(df, order).collect()
    assert sorted(small) == sorted(large)
    assert sorted(r.position for r in large) == list(range(300))


def test_average_rank_matches_pandas(spark):
    values = [1.0, 2.0, 2.0, 5.0] + [3.5] * 40 + [0.0] * 25 + [None] * 3
    df = keyed(list(enumerate(values)), "id long, v double", spark)
    want = pd.Series(values).rank().tolist()
    got = {r.id: r.r for r in average_rank(df, "v", "r").collect()}
    assert [got[i] for i in range(len(values) - 3)] == want[:-3] and {got[i] for i in range(len(values) - 3, len(values))} == {None}


def test_running_total(spark):
    df = keyed([(i, (i * 7) % 11) for i in range(200)], "id long, n long", spark)
    got = {r.id: r.t for r in running_total(df, [F.desc("id")], "n", "t").collect()}
    total = 0
    for i in range(199, -1, -1):
        total += (i * 7) % 11
        assert got[i] == total


def test_bands_by_position(spark):
    df = keyed([(f"z{i}", float(100 - i)) for i in range(10)], "id string, score double", spark)
    bands = {r.id: r.band for r in band_by_position(df, [F.desc("score")], 10, "band").collect()}
    assert [bands[f"z{i}"] for i in range(10)] == ["Very High"] * 2 + ["High"] * 2 + ["Medium"] * 3 + ["Low"] * 3


def test_constant_column_normalises_to_zero(spark):
    df = keyed([("a", 5, 1), ("b", 5, 3)], "id string, x long, y long", spark)
    rows = {r.id: r for r in log_minmax(df, ["x", "y"]).collect()}
    assert rows["a"].norm_x == rows["b"].norm_x == 0.0
    assert (rows["a"].norm_y, rows["b"].norm_y) == (0.0, 1.0)


def greedy(zones, officers, trucks):
    out = {}
    for zone, band in zones:
        need = S.MANPOWER[band]
        if need and officers:
            give = min(need, officers)
            officers -= give
            tow = int(band == "Very High" and trucks > 0)
            trucks -= tow
            out[zone] = (give, tow)
    return out


@pytest.mark.parametrize("officers,trucks", [(0, 2), (1, 0), (7, 1), (8, 2), (20, 2), (500, 50)])
def test_allocation_matches_greedy(spark, officers, trucks):
    rng = np.random.default_rng(officers)
    rows = [(f"Z{i:02d}", f"n{i}", S.BANDS[int(rng.integers(0, 4))], float(100 - i), float(i)) for i in range(40)]
    recs = keyed(rows, f"zone_id string, zone_name string, predicted_risk_band string, predicted_risk_score double, {deployment.FORECAST} double", spark)
    got = {r.zone_id: (r.officers_assigned, r.trucks_assigned) for r in deployment.allocate(recs, officers, trucks).collect()}
    assert got == greedy([(r[0], r[2]) for r in rows], officers, trucks)
    cover = deployment.coverage(recs, officers, trucks).first()
    assert cover.officers_deployed == sum(g for g, _ in got.values())
    assert 5 <= cover.random_pct <= 25


def test_precision_at_k_rules(spark):
    days = [DAY0 + dt.timedelta(days=i) for i in range(4)]
    rows = []
    for z in range(5):
        rows.append((days[0], f"Z{z}", float(z), float(z)))            # perfect
        rows.append((days[1], f"Z{z}", 1.0, 2.0))                      # all tied: the same zones win on both sides
        rows.append((days[2], f"Z{z}", 0.0, float(z)))                 # nothing happened: skipped
    rows.append((days[3], "Z0", 3.0, 3.0))                             # fewer than k zones: skipped
    rows += [(days[3], "Z1", 1.0, 0.0)]
    df = spark.createDataFrame([("m", "raw", "val", d, z, y, p) for d, z, y, p in rows],
                               "model_name string, variant string, split string, created_date date, zone_id string, y double, yhat double")
    daily = {r.created_date: r.precision for r in evaluation.daily_precision_at_k(df, ["split"], 3, per_day=True).collect()}
    assert daily == {days[0]: 1.0, days[1]: 1.0}
    assert evaluation.daily_precision_at_k(df.filter("y = 0"), ["split"], 3).first().p10 == 0.0


def test_both_top_k_of_a_day_come_from_one_exchange(spark):
    text = F.col("id").cast("string")
    df = spark.range(1000).select(
        (F.col("id") % 3).cast("string").alias("model_name"), (F.col("id") % 2).cast("string").alias("split"),
        F.date_add(F.lit(DAY0), (F.col("id") % 5).cast("int")).alias("created_date"), text.alias("zone_id"),
        F.col("id").cast("double").alias("y"), F.rand(1).alias("yhat"),
    )
    plan = evaluation.day_metrics(df, ["model_name", "split"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Window ") == 2


def test_histogram_and_stats(spark):
    values = [0.0, 0.49, 0.5, 1.0, 4.99, 5.0, 20.0, 99.9, 100.0, 1e6]
    df = keyed([(f"Z{i}", v, 0.0, -v, v) for i, v in enumerate(values)], "zone_id string, actual double, predicted double, error double, absolute_error double", spark)
    got = [r.zones for r in evaluation.error_histogram(df).orderBy("bin").collect()]
    assert got == [2, 1, 1, 1, 1, 0, 1, 1, 2]
    stats = evaluation.error_stats(df).first()
    assert stats.median_error == sorted(values)[5] and stats.under_1 == 3 and stats.over_20 == 4


def test_risk_upgrades(spark):
    rows = [(f"Z{i}", float(i), 0.0 if i < 2 else 99.0, ["Very High", "High"][i] if i < 2 else "Low", "night") for i in range(10)]
    df = keyed(rows, "zone_id string, yhat double, lag_1_count double, hotspot_band string, dominant_time_bucket string", spark)
    got = {r.zone_id: (r.predicted_risk_band, r.predicted_risk_score) for r in deployment.risk_scores(df).collect()}
    assert got["Z0"] == ("Low", 10.0)        # 0 is not above 0
    assert got["Z1"] == ("High", 70.0)
    assert got["Z9"] == ("Very High", 100.0) and got["Z6"] == ("High", 70.0) and got["Z3"] == ("Medium", 40.0)


def test_blend_weights_sum_to_one(spark):
    rows = [(m, "raw", "val", f"Z{i}", DAY0, float(i), float(i + e)) for m, e in (("a", 1), ("b", 3)) for i in range(3)]
    df = spark.createDataFrame(rows, "model_name string, variant string, split string, zone_id string, created_date date, y double, yhat double")
    w = {r.model_name: r.weight for r in evaluation.blend_weights(df).collect()}
    assert w == pytest.approx({"a": 0.75, "b": 0.25})
    best = evaluation.blend(df, "w", evaluation.blend_weights(df)).filter("zone_id = 'Z0'").first()
    assert best.yhat == pytest.approx(1.5)


def test_panel_reads_the_records_once_and_appends_days(spark, tmp_path):
    from conftest import SF_DIR
    from zonecast.plans.workspace import workspace
    from zonecast.sources import marts

    w = workspace(spark, SF_DIR)
    plan = panel.daily_counts(w.labelled)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "labelled" not in panel.zone_daily_features(w.cube, w.zones)._jdf.queryExecution().toString()
    path, days = str(tmp_path / "panel"), sorted(r.d for r in w.cube.select(F.col("created_date").alias("d")).distinct().collect())
    whole = panel.zone_daily_features(w.cube, w.zones)
    for cut in (days[70], days[-1], days[1]):
        marts.write_panel(panel.zone_daily_features(w.cube.filter(F.col("created_date") < F.lit(cut)), w.zones), path)
        marts.append_panel(panel.appended_features(w.cube, w.zones, str(cut)), path)
        back = marts.read_table(spark, path).select(*whole.columns)
        assert back.count() == whole.count() and back.exceptAll(whole).count() == 0
    last = marts.read_last_month(spark, path)
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(panel_month" in plan
    assert all("panel_month=2024-04" in r.f for r in last.select(F.input_file_name().alias("f")).distinct().collect())
    assert last.agg(F.max("created_date")).first()[0] == days[-1]
