"""Times the headline queries on the test tables and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2).
Each query runs once to warm up (fits are not kept from run to run) and then BENCH_RUNS times to the end (no-op sink); the
median counts.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from precinct.plans import model_queries  # noqa: E402
from precinct.plans.registry import QUERIES  # noqa: E402
from precinct.session import build_session  # noqa: E402

HEADLINE = [
    "missing_profile", "cardinality", "duplicate_profile", "clean_dedup", "repeated_key_rows", "describe_numeric",
    "quartiles_exact", "class_distribution", "daily_iqr_flags", "density_grid", "category_mix_all", "findings",
    "hotspots", "trend_grid", "stratified_split", "mix_features_all", "overall_metrics", "rank_results",
    "average_probabilities", "logistic_regression",
]


def run(spark, name: str, folder: str) -> float:
    model_queries.forget()
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
