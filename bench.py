"""Benchmark: headline queries of the four job families.

Runs each query once to warm up, then ``BENCH_RUNS`` times (default 3), and
reports the median wall time per query.  Queries execute through the ``noop``
sink (full plan, no result transfer to the driver).  Prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3), BENCH_QUERIES (comma list to override the set).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "growth_table",          # job 1: harmonisation end to end
    "rescue_incomplete",
    "quantile_summary",      # job 2: exact quantiles + quantile of quantiles (flagship)
    "box_stats",
    "ratio_sweep",           # 4,000,400-cell sweep
    "mixture_curves",
    "survey_rollup",         # job 3: nested roll-up
    "contribution",
    "draw_summary",          # job 4: posterior draws
    "rhat_rank",
    "effect_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from reefline.plans.catalogue import QUERIES
    from reefline.session import drop_intermediate_tables, get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)), app_name="reefline-bench",
                        driver_memory=os.environ.get("REEFLINE_DRIVER_MEMORY", "16g"))
    timings: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]

        def once() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()   # warm-up
        timings[name] = round(statistics.median(once() for _ in range(runs)), 3)
        drop_intermediate_tables(spark)
        print(f"{name}: {timings[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
