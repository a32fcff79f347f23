"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].

Prints one JSON line. Each query is timed end to end (plan + full execution into Spark's no-op sink),
warm median of 3. ``panel_build`` times deriving and materialising the four input tables (done once per
session and shared by the other queries, like reading the input files).
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["risk_pipeline", "risk_pipeline_model", "robust_z", "quantile_alert", "roc_auc", "parse_utterance",
            "latest_risk", "topk_risk", "stratified_split", "quickscore"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    from storewatch.plans import catalog, load_all
    from storewatch.session import local_session

    load_all()
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="storewatch-bench")

    def run(name: str) -> float:
        t0 = time.perf_counter()
        catalog.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    times = {}
    builds = []
    for i in range(reps + 1):          # first round warms the JVM
        catalog.reset_cache()
        t0 = time.perf_counter()
        catalog.panel(spark, sf_dir)
        builds.append(time.perf_counter() - t0)
    times["panel_build"] = statistics.median(builds[1:])
    for name in HEADLINE:
        runs = []
        for i in range(reps + 1):
            catalog.drop_scored()
            runs.append(run(name))
        times[name] = statistics.median(runs[1:])
    total = sum(times.values())
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in times.items()}, "sf": sf,
                      "cpus": cpus, "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
