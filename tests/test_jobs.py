"""The batch pipeline from a record table to all marts, with few rounds."""

import pytest

from conftest import SF_DIR
from zonecast.operators import models
from zonecast.plans.jobs import BatchJobs, Settings, read_records
from zonecast.sources import schemas
from zonecast.sources.marts import MissingInput, load_catalog
from zonecast.sources.records import records_from_events

SMALL = {
    "RandomForest": {"numTrees": 2, "maxDepth": 3}, "HistGradientBoosting": {"maxIter": 2, "maxDepth": 2},
}
SPACE = {"maxIter": (2, 3, "int"), "maxDepth": (2, 3, "int"), "stepSize": (0.1, 0.2, "log")}


def record_path(spark, tmp_path, fmt):
    path = str(tmp_path / ("records.csv" if fmt == "csv" else "records"))
    source = records_from_events(spark, spark.read.parquet(f"{SF_DIR}/events.parquet")).select(*schemas.RECORDS.fieldNames())
    getattr(source.write.option("header", True), fmt)(path)
    return path


def test_all_jobs(spark, tmp_path):
    marts = str(tmp_path / "marts")
    settings = Settings(n_trials=1, families=("Poisson Regressor", "RandomForest"), tuned=("LightGBM", "XGBoost"),
                        overrides=SMALL, space=SPACE, sample=20)
    pipe = BatchJobs(spark, read_records(spark, record_path(spark, tmp_path, "parquet")), marts, settings)
    with pytest.raises(MissingInput, match="panel job"):
        pipe.run("benchmark")
    pipe.run("all")
    loaded = load_catalog(spark, marts)
    counts = {name: df.count() for name, df in loaded.items()}
    assert counts["hotspot_zones"] == counts["deployment_recommendations"] == counts["prediction_error_analysis"] == 16
    assert counts["temporal_heatmap"] == 168 and counts["hotspot_summary_report"] == 14 and counts["best_model"] == 1
    assert counts["model_leaderboard"] == 7 and counts["feature_importance"] == 99
    assert counts["predictions"] == 4 * 31 * 16
    assert min(counts.values()) > 0


def test_csv_in_and_out(spark, tmp_path):
    marts = str(tmp_path / "marts")
    pipe = BatchJobs(spark, read_records(spark, record_path(spark, tmp_path, "csv")), marts, Settings(fmt="csv"))
    pipe.run("hotspots")
    pipe.run("heat")
    loaded = load_catalog(spark, marts, "csv")
    assert loaded["hotspot_zones"].schema.fieldNames() == [*schemas.HOTSPOT_ZONES.fieldNames(), "position"]
    zones = loaded["hotspot_zones"].orderBy("position").collect()
    assert sorted(map(tuple, loaded["hotspot_zones"].drop("position").collect())) == sorted(map(tuple, pipe.work.zones.collect()))
    assert [r.hotspot_score for r in zones] == sorted((r.hotspot_score for r in zones), reverse=True)
    assert loaded["temporal_heatmap"].count() == 168


def test_missing_records(spark, tmp_path):
    with pytest.raises(MissingInput):
        read_records(spark, str(tmp_path / "none"))
    with pytest.raises(MissingInput):
        read_records(spark, str(tmp_path / "none.csv"))


def test_all_families_are_listed():
    assert len(models.PRESETS) == 8  # with the two baselines: ten families
