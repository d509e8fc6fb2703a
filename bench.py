"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and then three times (BENCH_RUNS); its time is the median. The heavy
queries in ONCE, which fit models of 200 trees or refresh all views, run a single time after all others;
they are listed as ``single_run`` and are part of the total. Each model query fits its own model, in its time. Results are
written to a sink that takes all rows and keeps none; what a query staged is removed after it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.registry import QUERIES  # noqa: E402
from kerbstat.session import local_session, staging  # noqa: E402

HEADLINE = [
    "ticket_scan",
    "geo_scan",
    "training_load",
    "training_sample",
    "violation_summary",
    "location_summary",
    "temporal_distribution",
    "fine_distribution",
    "violations_top",
    "hotspots_top",
    "heatmap_points",
    "location_risk_scores",
    "temporal_patterns",
    "precinct_stats",
    "street_stats",
    "violation_stats",
    "monthly_trends",
    "agency_stats",
    "features_final",
    "vocabulary",
    "encoded_features",
    "rare_class_filter",
    "stratified_split",
    "metric_per_class",
    "metric_topk",
    "metric_report",
    "confusion_topn",
    "topk_classes",
    "table_info",
    "chunk_totals",
    "csv_roundtrip",
    "view_roundtrip",
]
ONCE = ["view_refresh", "train_predict", "boosted_predict", "saved_model_report", "score_requests"]


def seconds(query, spark, path: str) -> float:
    with staging(spark):
        start = time.perf_counter()
        query(spark, path).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE + ONCE)).split(",")
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus})
    took = {}
    for name in names:
        if name not in ONCE:
            seconds(QUERIES[name], spark, path)
        once = name in ONCE
        times = [seconds(QUERIES[name], spark, path) for _ in range(1 if once else runs)]
        took[name] = round(statistics.median(times), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total time of the headline queries: warm medians, and single runs of the heavy ones",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "single_run": [name for name in took if name in ONCE],
        "sf": Path(path).name.removeprefix("sf"),
        "cpus": int(cpus) if cpus.isdigit() else cpus,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
