"""Headline queries, timed: python bench.py prints one line of JSON.

Each query is run once to warm up and then timed until its rows are all computed (a noop write); the value
is the sum of the medians. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set input, threads and repeats.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)

HEADLINE = (
    "latest_wins", "live_view", "get_many_ordered", "record_layout", "range_merge", "batch_io_counters", "mean_of_ratios", "colocated_pair_ratio",
    "coaccess_edges", "edge_merge", "edge_prune", "graph_stats", "affinity_edges", "components", "layout_plan", "budget_select", "relocated_layout",
    "adapted_vs_baseline", "nearest_rank_p50_p95", "sign_flips", "workload_random", "harness_small",
)


def main() -> None:
    from keelson.plans.catalogue import QUERIES
    from keelson.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, cpus, "8g")
    times = {}
    for name in HEADLINE:
        taken = []
        for k in range(repeats + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
