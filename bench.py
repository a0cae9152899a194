"""Headline queries, warm: the median of BENCH_RUNS timed runs (three by default; one of a query that takes over 20 s; of one
that takes over a minute the first run counts)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "file_eer_by_family", "cluster_bootstrap_ci", "grid_sweep_rank", "presence_interval_join",
    "window_targets", "pooling_variants", "smooth_max_pooling", "tree_score_support29",
    "slice_metrics", "weight_curve", "identity_leaks", "manifest_violations", "window_file_scores", "source_components",
)


def main() -> None:
    from segmetrica.plans import load_all
    from segmetrica.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]
    times = {}
    for name in HEADLINE:
        laps = []
        while len(laps) <= runs and not (len(laps) > 1 and laps[-1] > 20) and not (laps and laps[0] > 60):
            t = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - t)
        times[name] = round(statistics.median(laps[1:] or laps), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("lineitem", "orders", "customer", "documents")}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf).name.removeprefix("sf"), "rows": rows,
    }))


if __name__ == "__main__":
    main()
