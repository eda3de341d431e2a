"""Time the stages and reports on one data set and print one JSON line.

Each stage is timed once, in pipeline order, on a fresh workspace; a stage reads the tables that earlier stages wrote,
as the jobs of the batch pipeline do. Reports are timed with their result fully computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from zonecast.plans.catalog import QUERIES, lineitem_panel  # noqa: E402
from zonecast.plans.workspace import Workspace  # noqa: E402
from zonecast.operators import models, panel  # noqa: E402
from zonecast.session import local_session  # noqa: E402

REPORTS = [
    "temporal_heatmap", "heatmap_peaks", "dbscan_labels", "summary_report", "daily_precision_at_k", "blend_weighted",
    "baseline_leaderboard", "error_stats", "recommendations", "allocation", "coverage", "impact_score", "map_popup",
    "zone_inspector",
]


def compute(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session("bench", cpus=cpus, memory=os.environ.get("BENCH_MEMORY", "6g"), partitions=int(cpus))
    w = Workspace(spark, sf_dir)
    stages = {
        "stage_records": lambda: compute(w.records),
        "stage_dbscan": lambda: compute(w.clustering.nodes),
        "stage_label_records": lambda: compute(w.labelled),
        "stage_hotspot_zones": lambda: compute(w.zones),
        "stage_entity_ranking": lambda: compute(w.ranking),
        "stage_panel_features": lambda: compute(w.features),
        "stage_baseline_evaluation": lambda: compute(w.baselines),
        "stage_recommendations": lambda: compute(w.recs),
        "panel_lineitem": lambda: compute(panel.time_features(lineitem_panel(w))),
        **{name: (lambda q=QUERIES[name]: compute(q(w))) for name in REPORTS},
        "fit_poisson": lambda: models.fit("Poisson Regressor", models.training_rows(w.training)),
        "fit_boosted_20_rounds": lambda: models.fit(
            "LightGBM", models.training_rows(w.training), {"maxIter": 20, "maxDepth": 5}
        ),
    }
    if os.environ.get("BENCH_PUBLISHED"):  # minutes: all families at their published sizes
        stages |= {
            "benchmark_published": lambda: models.fit_families(w.training),
            "attribution_500_rows": lambda: compute(QUERIES["attribution_summary"](w)),
            "search_of_queries": lambda: compute(w.tuning[0]),
        }
    compute(spark.range(1000))
    seconds = {}
    for name, run in stages.items():
        start = time.monotonic()
        run()
        seconds[name] = round(time.monotonic() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "hotspot, forecast and deployment stages, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
