"""The batch pipeline: each job reads the records or earlier marts and writes its own marts.

    python -m zonecast.plans.jobs all --records /data/records.parquet --marts /data/marts
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.operators import attribution, deployment, evaluation, heatmap, impact, models, panel, tuning, zones
from zonecast.operators.dbscan import split_usable
from zonecast.plans.workspace import Workspace
from zonecast.session import materialize, prepare
from zonecast.sources.marts import read_csv, read_csv_checked, read_last_month, read_table, write_mart, write_ordered, write_panel
from zonecast.sources.schemas import RECORDS


@dataclass
class Settings:
    """Defaults are the published ones."""

    fmt: str = "parquet"
    eps_m: float = 100.0
    min_samples: int = 10
    n_trials: int = tuning.N_TRIALS
    families: tuple[str, ...] = tuple(models.PRESETS)
    tuned: tuple[str, ...] = models.TUNED
    overrides: dict[str, dict] = field(default_factory=dict)
    space: dict | None = None
    sample: int = 500


def read_records(spark: SparkSession, path: str, rejects: str | None = None) -> DataFrame:
    """The record table; lines of a CSV table that do not fit go to the mart `rejects` with the reason."""
    if not path.endswith(".csv"):
        return read_table(spark, path)
    rows, rejected = read_csv_checked(spark, path, RECORDS)
    if rejects:
        write_mart(rejected, rejects)
    return rows


class BatchJobs:
    def __init__(self, spark: SparkSession, records: DataFrame, marts: str, settings: Settings | None = None):
        self.settings = settings or Settings()
        self.spark, self.marts = prepare(spark), marts
        self.work = Workspace(spark, marts, self.settings.eps_m, self.settings.min_samples, source=records)

    def _write(self, df: DataFrame, name: str) -> None:
        write_mart(df, f"{self.marts}/{name}", self.settings.fmt)

    def _panel(self) -> DataFrame:
        return read_table(self.spark, f"{self.marts}/zone_daily_features", hint="run the panel job first").drop("panel_month")

    @cached_property
    def _split(self) -> DataFrame:
        return evaluation.with_split(panel.modeling_rows(self._panel()))

    @cached_property
    def _training(self) -> DataFrame:
        return models.training_table(self._split)

    def hotspots(self) -> None:
        """Zones, rankings, map layer and summary; stops if records are lost or a score is out of range."""
        w = self.work
        _, bad = split_usable(w.records)
        zones.check_conservation(w.records, w.labelled, bad).collect()
        zones.check_scores(w.zones).collect()
        write_ordered(w.zones, f"{self.marts}/hotspot_zones", [F.desc("hotspot_score"), F.desc("total_violations"), F.col("zone_id")], self.settings.fmt)
        self._write(w.ranking, "location_ranking")
        self._write(impact.map_layer(w.zones).select(*impact.MAP_COLUMNS), "hotspot_map_data")
        self._write(w.summary, "hotspot_summary_report")

    def heat(self) -> None:
        self._write(heatmap.temporal_heatmap(self.work.records), "temporal_heatmap")

    def panel(self) -> None:
        """Feature table, first evaluation of baseline, forest and boosting, first recommendations."""
        write_panel(self.work.features, f"{self.marts}/zone_daily_features")
        for stale in ("_split", "_training", "_tuned", "_forecasts"):
            self.__dict__.pop(stale, None)
        train, held_out = models.training_rows(self._training), self._training.filter("split <> 'train'")
        fitted = [models.fit(n, train, self._override(n)) for n in ("RandomForest", "HistGradientBoosting")]
        preds = [evaluation.baseline_predictions(self._split), *[m.predictions(held_out) for m in fitted]]
        names = {"Persistence (lag_1)": "baseline", "RandomForest": "rf", "HistGradientBoosting": "hgb"}
        self._write(evaluation.eval_wide(reduce(DataFrame.unionByName, preds), names), "model_eval")
        self._write(self._recommend([fitted[-1]], None), "first_recommendations")

    def benchmark(self) -> None:
        fits = models.fit_families(self._training, list(self.settings.families), self.settings.overrides)
        _, board, seconds = models.benchmark(self._split, self._training, fits)
        self._write(models.with_seconds(board, seconds), "model_leaderboard")

    def tune(self) -> None:
        options = {"n_trials": self.settings.n_trials, "space": self.settings.space}
        results, _ = tuning.tuning_results(self._training, self.settings.tuned, **options)
        self._write(results, "tuning_results")

    @cached_property
    def _tuned(self) -> list[models.Fitted]:
        # one row per tuned family
        path = f"{self.marts}/tuning_results"
        stored = read_csv(self.spark, path) if self.settings.fmt == "csv" else read_table(self.spark, path, hint="run the tune job first")
        rows = stored.select("model_name", "best_params").orderBy("model_name").collect()
        return models.refit([(r.model_name, r.best_params) for r in rows], self._training)

    @cached_property
    def _forecasts(self) -> DataFrame:
        held_out = self._training.filter("split <> 'train'")
        singles = reduce(DataFrame.unionByName, [m.predictions(held_out) for m in self._tuned])
        return materialize(evaluation.with_blends(materialize(singles, "tuned")), "forecasts")

    def ensemble(self) -> None:
        """Tuned models and their two blends, and the forecasts behind them."""
        self._write(self._forecasts, "predictions")
        self._write(evaluation.leaderboard(self._forecasts).drop("variant"), "ensemble_results")

    def export(self) -> None:
        """Best approach, its recommendations, importances, attributions and errors."""
        fitted, preds = self._tuned, self._forecasts
        board = evaluation.leaderboard(preds)
        best = evaluation.best_model(board)
        self._write(best, "best_model")
        name = best.first().best_model  # one row
        weights = None
        if name == evaluation.WEIGHTED_BLEND:
            rows = evaluation.blend_weights(preds.filter(~F.col("model_name").contains("Ensemble"))).collect()
            weights = {r.model_name: r.weight for r in rows}  # one weight per tuned family
        chosen = fitted if "Ensemble" in name else [m for m in fitted if m.name == name]
        write_ordered(self._recommend(chosen, weights), f"{self.marts}/deployment_recommendations", deployment.risk_order(), self.settings.fmt)
        train = models.training_rows(self._training)
        # the two leading boosted families and a forest of half the trees are shown; the first of the two is explained row by row
        shown = [m for name in ("LightGBM", "XGBoost") for m in fitted if m.name == name]
        forest = models.fit("RandomForest", train, {"numTrees": 100, **(self._override("RandomForest") or {})})
        self._write(models.importances([*shown, forest]), "feature_importance")
        sample = attribution.sample_rows(train, self.settings.sample)
        parts = attribution.contributions((shown or fitted)[0], sample)
        self._write(attribution.mean_attribution(parts, sample.count()), "feature_attribution")
        self._write(evaluation.error_analysis(evaluation.choose_best(preds, board)), "prediction_error_analysis")

    def _override(self, name: str) -> dict | None:
        return self.settings.overrides.get(name)

    def _recommend(self, fitted: list[models.Fitted], weights: dict[str, float] | None) -> DataFrame:
        """Recommendations for the last feature day from the (weighted) mean of the given models."""
        # the folder names give the month, so one month is read
        day = deployment.last_day(read_last_month(self.spark, f"{self.marts}/zone_daily_features", hint="run the panel job first")).drop("panel_month")
        kept = [*deployment.RECOMMENDATION_COLUMNS[:5], "lag_1_count", "hotspot_band", "dominant_time_bucket"]
        table = models.assemble(day, kept)
        share = weights or {m.name: 1 / len(fitted) for m in fitted}
        forecast = table
        for i, m in enumerate(fitted):
            scored = m.forecast(table).select("zone_id", (F.col("yhat") * share[m.name]).alias(f"_y{i}"))
            forecast = forecast.join(scored, "zone_id")
        total = reduce(lambda a, b: a + b, [F.col(f"_y{i}") for i in range(len(fitted))])
        return deployment.recommendations(forecast.drop("features").withColumn("yhat", total))

    JOBS = ("hotspots", "heat", "panel", "benchmark", "tune", "ensemble", "export")

    def run(self, job: str) -> None:
        for name in self.JOBS if job == "all" else [job]:
            getattr(self, name)()


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=[*BatchJobs.JOBS, "all"])
    parser.add_argument("--records", required=True)
    parser.add_argument("--marts", required=True)
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    args = parser.parse_args()
    spark = SparkSession.builder.appName(f"zonecast-{args.job}").getOrCreate()
    records = read_records(spark, args.records, f"{args.marts}/rejected_records")
    BatchJobs(spark, records, args.marts, Settings(fmt=args.format)).run(args.job)


if __name__ == "__main__":
    main()
