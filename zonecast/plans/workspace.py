"""Stage tables of one data set, each written once and reused by every later job."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators import deployment, entities, evaluation, heatmap, models, panel, reports, tuning, zones
from zonecast.operators.cleaning import prepare_records
from zonecast.operators.dbscan import Clustering, dbscan, split_usable
from zonecast.session import materialize, prepare
from zonecast.sources.marts import read_table
from zonecast.sources.records import records_from_events


class Workspace:
    """Records to recommendations. Properties are stages; each large one is a table in the shared folder."""

    def __init__(
        self, spark: SparkSession, sf_dir: str, eps_m: float = 100.0, min_samples: int = 10,
        source: DataFrame | None = None,
    ):
        """`sf_dir` holds the generic tables; `source` is a record table to use instead of the one built from events."""
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        self.source = source
        self.key = hashlib.md5(sf_dir.encode()).hexdigest()[:12]
        self.eps_m, self.min_samples = eps_m, min_samples

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet", columns)

    @cached_property
    def records(self) -> DataFrame:
        if self.source is not None:
            return prepare_records(self.source)
        derived = records_from_events(self.spark, self.table("events"))
        return prepare_records(materialize(derived, "records"))

    @cached_property
    def clustering(self) -> Clustering:
        return dbscan(self.records, eps_m=self.eps_m, min_samples=self.min_samples)

    @cached_property
    def labelled(self) -> DataFrame:
        """Usable records with their zone, or ZONE_NOISE."""
        usable, _ = split_usable(self.records)
        return materialize(zones.label_records(usable, self.clustering), "labelled")

    @cached_property
    def zones(self) -> DataFrame:
        return materialize(zones.hotspot_zones(self.labelled), "hotspot_zones")

    @cached_property
    def n_zones(self) -> int:
        return self.zones.count()

    @cached_property
    def ranking(self) -> DataFrame:
        return materialize(entities.rank_entities(self.records), "location_ranking")

    @cached_property
    def heatmap(self) -> DataFrame:
        return heatmap.temporal_heatmap(self.records)

    @cached_property
    def cube(self) -> DataFrame:
        return panel.daily_cube(self.labelled)

    @cached_property
    def panel(self) -> DataFrame:
        return panel.panel_of(self.cube)

    @cached_property
    def features(self) -> DataFrame:
        return materialize(panel.zone_daily_features(self.cube, self.zones), "zone_daily_features")

    @cached_property
    def split_rows(self) -> DataFrame:
        return evaluation.with_split(panel.modeling_rows(self.features))

    @cached_property
    def baselines(self) -> DataFrame:
        """Forecasts of the two baselines and of their blends."""
        return materialize(evaluation.with_blends(evaluation.baseline_predictions(self.split_rows)), "predictions")

    @cached_property
    def board(self) -> DataFrame:
        return materialize(evaluation.leaderboard(self.baselines), "leaderboard")

    @cached_property
    def errors(self) -> DataFrame:
        return materialize(evaluation.error_analysis(evaluation.choose_best(self.baselines, self.board)), "errors")

    def recommend(self, yhat: str) -> DataFrame:
        """Deployment table with a feature column as the forecast."""
        day = deployment.last_day(self.features).withColumn("yhat", F.col(yhat).cast("double"))
        return deployment.recommendations(day)

    @cached_property
    def recs(self) -> DataFrame:
        return materialize(self.recommend("rolling_7d_mean"), "recommendations")

    @cached_property
    def summary(self) -> DataFrame:
        return materialize(reports.summary_report(self.labelled, self.zones), "summary")

    # -- fitted models

    @cached_property
    def training(self) -> DataFrame:
        return models.training_table(self.split_rows)

    @cached_property
    def fits(self) -> list[models.Fitted]:
        """Every family in its variants, at the published sizes."""
        return models.fit_families(self.training)

    @cached_property
    def benchmark(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return models.benchmark(self.split_rows, self.training, self.fits)

    @cached_property
    def explained(self) -> list[models.Fitted]:
        raw = {m.name: m for m in self.fits if m.variant == "raw"}
        return [raw[name] for name in ("LightGBM", "XGBoost", "RandomForest")]

    @cached_property
    def tuning(self) -> tuple[DataFrame, list[models.Fitted]]:
        """The published search of each tuned family."""
        return tuning.tuning_results(self.training)


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of a data set in this Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]
