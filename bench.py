"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from launchgrid.catalog import CATALOG  # noqa: E402
from launchgrid.session import local_session  # noqa: E402

HEADLINE = [
    "load_facts", "release_dates", "pair_window", "target_grid", "ratio_profile", "market_level", "site_stats",
    "calendar_diff", "item_opening", "competition", "pair_rank", "error_segments", "calibrate_blend",
    "calibrate_horizon", "backoff_zero", "absorbing_zero", "build_output", "prob_variants",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        if name not in CATALOG:
            continue
        seen = []
        for _ in range(runs + 1):  # the first run warms code generation and is dropped
            t0 = time.perf_counter()
            CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(seen[1:]), 3)
    print(json.dumps({"metric": "launch_demand_headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
