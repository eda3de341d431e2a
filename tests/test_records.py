"""Cleaning, zones, entities and marts on hand-made records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from zonecast.functions import scalars as S
from zonecast.operators import cleaning, entities, heatmap, zones
from zonecast.operators.skew import hot_keys, lookup_join
from zonecast.sources import marts, schemas


def test_modes_and_distinct_counts(spark):
    rows = [("a", v) for v in ["y", "x", "x", "y", None, "No Junction", "No Junction", "No Junction"]] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v string")
    counts = zones.value_counts(df, "g", ["v"])
    got = counts.groupBy("g").agg(
        zones.mode_of("v", "none").alias("m"), zones.mode_of("v", "none", without="No Junction").alias("other"),
        zones.distinct_of("v").alias("n"),
    ).collect()
    assert [tuple(r) for r in got] == [("a", "No Junction", "x", 3)]


def test_hour_mode_orders_numbers(spark):
    df = spark.createDataFrame([("a", 10), ("a", 9)], "g string, h int")
    assert zones.value_counts(df, "g", ["h"]).agg(zones.mode_of("h", "12", numeric=True)).first()[0] == 9


def test_zone_names(spark):
    rows = [
        ("BTP051 - Mill Plaza Junction", "Mill", "Central"), ("BTP040 - Oak Junction", "5th Row", "West"),
        ("No Junction", "Fish Market", "City"), ("junction Junction", "X", "S"),
    ]
    df = spark.createDataFrame(rows, "j string, g string, s string")
    got = [r[0] for r in df.select(S.zone_name(F.col("j"), F.col("g"), F.col("s"))).collect()]
    assert got == ["Mill Plaza / Central Zone", "5th Row / Oak Zone", "Fish Market / City Zone", "X / junction Zone"]


def test_rounding_and_labels(spark):
    row = spark.range(1).select(
        S.round_half_even(F.lit(0.125), 2).alias("a"), S.round_half_even(F.lit(0.375), 2).alias("b"),
        S.round_half_up(F.lit(2.5)).alias("c"), S.round_half_up(F.lit(-2.5)).alias("d"),
        S.percent_text(F.lit(0.42134), 2).alias("e"), S.hour_label(F.lit(0)).alias("f"), S.hour_label(F.lit(12)).alias("g"),
        S.hour_range(F.lit(23)).alias("h"), S.band_style(F.lit("Very High")).alias("i"),
        S.lookup(F.lit("x"), {"y": 1}, 7).alias("j"), S.week_of_month(F.lit(dt.date(2024, 4, 8))).alias("k"),
    ).first()
    assert tuple(row) == (0.12, 0.38, 3, -2, "42.13%", "12A", "12P", "11:00 PM - 12:00 PM", "very-high", 7, 2)


def test_road_weight_and_thresholds(spark):
    names = ["Outer Ring Road / A", "K Flyover", "Town Hall Junction / B", "Quiet Lane", "5th CROSS"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(S.road_weight(F.col("n"))).collect()] == [100, 80, 100, 40, 80]
    scores = spark.createDataFrame([(90.1,), (90.0,), (70.0,), (50.0,), (49.9,)], "s double")
    assert [r[0].split()[1] for r in scores.select(S.threshold_action(F.col("s"))).collect()] == ["towing", "2", "2", "monitoring", "action"]


def record_frame(spark):
    base = [(12.97, 77.59, "S1", "BTP001 - A Junction", "Main", "Main, 1"), (12.97, 77.5901, "S1", "No Junction", "Main", "Main, 2"),
            (12.98, 77.60, "unknown", "B Junction", None, "Side, 1"), (13.2, 77.9, "S2", "", "  ", "Far, 1")]
    rows, i = [], 0
    for n, b in zip((14, 9, 12, 3), base):
        for _ in range(n):
            rows.append((i, *b[:2], dt.date(2023, 11, 10) + dt.timedelta(days=i % 31), (i * 5) % 24, float(i % 31), i % 2, 1 - i % 2,
                         f"t{i % 3}", f"c{i % 2}", *b[2:]))
            i += 1
    return spark.createDataFrame(rows, schemas.RECORDS)


def test_records_to_zones(spark):
    from zonecast.operators.dbscan import dbscan

    records = cleaning.prepare_records(record_frame(spark))
    labelled = zones.label_records(records, dbscan(records))
    table = zones.hotspot_zones(labelled)
    got = {r.zone_id: r for r in table.collect()}
    assert len(table.columns) == 38 and set(got) == {"ZONE_001", "ZONE_002"}
    assert table.schema.fieldNames() == schemas.HOTSPOT_ZONES.fieldNames()
    one = got["ZONE_001"]
    assert (one.total_violations, one.top_police_station, one.top_junction, one.unique_locations) == (23, "S1", "BTP001 - A Junction", 2)
    assert one.zone_name == "Main / A Zone" and one.hotspot_score == 100.0 and one.hotspot_band == "Very High"
    assert sum(getattr(one, c) for c in zones.MONTH_COLUMNS) == 23
    check = zones.check_conservation(records, labelled, records.limit(0)).first()
    assert (check.clustered, check.noise, check.input) == (35, 3, 38)
    assert zones.check_scores(table).first().max_score == 100.0


def test_lost_records_are_noticed(spark):
    records = cleaning.prepare_records(record_frame(spark))
    labelled = records.withColumn("zone_id", F.lit("ZONE_001")).limit(5)
    with pytest.raises(Exception, match="records lost"):
        zones.check_conservation(records, labelled, records.limit(0)).collect()


def test_entity_ranking(spark):
    records = cleaning.prepare_records(record_frame(spark))
    got = entities.rank_entities(records).toPandas().sort_values("global_rank")
    assert list(got.global_rank) == list(range(1, len(got) + 1))
    assert set(zip(got.entity_type, got.entity_name)) == {
        ("Police Station", "S1"), ("Police Station", "S2"), ("Junction", "A"), ("Junction", "B"), ("Street/Location", "Main")}
    for _, g in got.groupby("entity_type"):
        assert list(g.entity_rank) == list(range(1, len(g) + 1))
    s1 = got[got.entity_name == "S1"].iloc[0]
    assert (s1.total_violations, s1.location_diversity, s1.hotspot_score) == (23, 2, 100.0)


def test_heatmap_is_dense(spark):
    records = cleaning.prepare_records(record_frame(spark))
    heat = heatmap.temporal_heatmap(records).toPandas()
    assert len(heat) == 168 and heat.violation_count.sum() == 38
    matrix = heatmap.heatmap_matrix(heatmap.temporal_heatmap(records)).toPandas()
    assert list(matrix.day_name) == S.DAYS and matrix[[f"h{h}" for h in range(24)]].to_numpy().sum() == 38


def test_lookup_join_keeps_every_row(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") if i % 10 else (i, None) for i in range(600)], "id long, k string")
    dim = facts.filter("k IS NOT NULL").select("k").distinct().withColumn("v", F.length("k"))
    for hot in (None, hot_keys(facts, ["k"])):
        got = lookup_join(facts, dim, ["k"], hot=hot).toPandas()
        assert sorted(got.id) == list(range(600))
        assert got[got.k.isna()].v.isna().all() and (got[got.k == "hot"].v == 3).all()


def test_column_and_key_normalisation(spark):
    df = cleaning.normalise_columns(spark.createDataFrame([(" zone_1 ", 1), ("", 2)], "` Zone  Id ` string, `N` int"))
    assert df.columns == ["zone_id", "n"]
    assert [r[0] for r in df.select(cleaning.normalise_key(F.col("zone_id"))).collect()] == ["ZONE_1", ""]


def test_days_since_start_and_counts(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), ["a", "b"]), (dt.datetime(2024, 1, 2, 12), [])], "ts timestamp, t array<string>")
    got = cleaning.violation_counts(cleaning.days_since_start(df, "ts"), "t", ["a"]).orderBy("ts").collect()
    assert [r.days_since_start for r in got] == [0.0, 1.5]
    assert [(r.parking_related_violation_count, r.non_parking_violation_count, r.primary_violation) for r in got] == [(1, 1, "a"), (0, 0, None)]


def test_marts(spark, tmp_path):
    with pytest.raises(marts.MissingInput, match="run the zones job"):
        marts.read_table(spark, str(tmp_path / "none"), hint="run the zones job first")
    empty = marts.read_or_default(spark, str(tmp_path / "none"), schemas.SUMMARY_REPORT)
    assert empty.count() == 0 and empty.schema == schemas.SUMMARY_REPORT
    rows = [("Ensemble (Final)", 0.5)]
    assert marts.read_or_default(spark, str(tmp_path / "none"), "m string, v double", rows).first().v == 0.5
    report = spark.createDataFrame([("a, b", '"1"'), ("c", "2%")], schemas.SUMMARY_REPORT)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt / "hotspot_summary_report")
        marts.write_mart(report, path, fmt)
        marts.write_mart(report, path, fmt)  # overwrites
        loaded = marts.load_catalog(spark, str(tmp_path / fmt), fmt)
        assert sorted(map(tuple, loaded["hotspot_summary_report"].collect())) == sorted(map(tuple, report.collect()))
        assert spark.sql("SELECT count(*) FROM hotspot_zones").first()[0] == 0
    (tmp_path / "x.csv").write_text("Zone Id, Value \nz1,3\n,\nz2,4.5\n")
    typed = marts.read_csv(spark, str(tmp_path / "x.csv"))
    assert typed.columns == ["zone_id", "value"] and [r.value for r in typed.collect()] == [3.0, 4.5]
    maps = spark.createDataFrame([('{"maxDepth": 5, "stepSize": 0.1}',)], "p string").select(marts.parse_parameters(F.col("p"))).first()[0]
    assert maps == {"maxDepth": "5", "stepSize": "0.1"}


def test_failed_write_leaves_the_mart(spark, tmp_path):
    path = str(tmp_path / "mart")
    marts.write_mart(spark.range(3), path)
    broken = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    for fmt in ("parquet", "csv"):
        with pytest.raises(Exception, match="lost"):
            marts.write_mart(broken, path, fmt)
        assert sorted(r.id for r in marts.read_table(spark, path).collect()) == [0, 1, 2]
    reading = marts.read_table(spark, path)  # a reader of the version before is not cut off by the next publish
    marts.write_mart(spark.range(5), path)
    assert reading.count() == 3 and marts.read_table(spark, path).count() == 5
    marts.write_mart(spark.range(6), path)
    assert len(list((tmp_path / "mart" / "_versions").iterdir())) == 2


def test_folder_without_manifest_is_read_as_it_is(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "plain"))
    assert marts.read_table(spark, str(tmp_path / "plain")).count() == 2


def test_ordered_mart_from_several_files(spark, tmp_path):
    rows = [(f"z{i:03d}", float(i * 37 % 50)) for i in range(200)]
    path = str(tmp_path / "ordered")
    marts.write_ordered(spark.createDataFrame(rows, "zone_id string, v double").repartition(5), path, [F.desc("v"), F.col("zone_id")])
    back = marts.read_table(spark, path)
    want = [z for z, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r.zone_id for r in back.orderBy("position").collect()] == want and len(back.inputFiles()) > 1
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.min("position").alias("a"), F.max("position").alias("b"), F.count("v").alias("n"))
    assert all(r.b - r.a + 1 == r.n for r in files.collect())


def test_checked_csv(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("day", T.DateType())])
    lines = ["id,name,day", '1,"a, b",2024-01-02', "2,c", "3,d,2024-01-02,more", "x,e,2024-01-02", "5,f,2024-02-31", "6,,", "", '7,"g",2024-03-04']
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    good, bad = marts.read_csv_checked(spark, str(tmp_path / "x.csv"), schema)
    assert sorted(r.id for r in good.collect()) == [1, 6, 7]
    assert sorted((r.reason, r.record[0]) for r in bad.collect()) == [("columns", "2"), ("columns", "3"), ("date", "5"), ("field", "x")]
    with pytest.raises(marts.MissingInput):
        marts.read_csv_checked(spark, str(tmp_path / "none.csv"), schema)


def test_order_statistics(spark):
    import random

    from zonecast.operators.evaluation import order_statistic, upper_median

    rng = random.Random(3)
    for values in ([], [4.0], [1.0, 2.0], [7.0] * 500 + [1.0, 9.0], [rng.gauss(0, 1e6) for _ in range(901)], [rng.choice([0.1, 0.2, 1e300, -1e300]) for _ in range(60)], [1.0, 1.0 + 2**-52, 1e9]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
        assert upper_median(df, "v") == (sorted(values)[len(values) // 2] if values else None)
        for k in {0, len(values) // 3, len(values) - 1} if values else ():
            assert order_statistic(df, "v", lambda n, k=k: k) == sorted(values)[k]
