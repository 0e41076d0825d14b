"""Benchmark the headline queries.

Runs each query over the tables in $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints one JSON line. Each query is forced to completion with the
``noop`` sink (the whole plan runs, nothing is collected to the driver). Each query runs
$BENCH_RUNS times (default 3); the median is reported, and the first (cold) run as well.
Set $BENCH_EVENTLOG_DIR to write Spark's event log (stage and task times) to that folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "fake_discounts",
    "win_01_rolling_mean",
    "agg_20_deal_board",
    "win_04_best_deal_per_seller",
    "agg_12_latest_snapshot",
    "join_08_forward_fill",
    "agg_15_pivot",
    "agg_21_campaign_rollup",
    "src_13_rewrite_recent_all",
    "agg_03_distribution",
    "sort_02_review_page",
    "agg_28_top_keywords",
    "ml_11_language_detect",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from souk.session import checkpoint_dir, get_spark
    # Driver heap: at most 16 GB and never more than 60% of this machine's memory.
    try:
        mem_gb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2 ** 30
    except (ValueError, OSError, AttributeError):
        mem_gb = 8.0
    heap = max(1, min(16, int(mem_gb * 0.6)))
    extra = {"spark.driver.memory": f"{heap}g"}
    if os.environ.get("BENCH_EVENTLOG_DIR"):   # stage/task times without the UI
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENTLOG_DIR"]})
    spark = get_spark(f"local[{cpus}]", app="souk-bench", shuffle_partitions=int(cpus) * 2, extra=extra)
    checkpoint_dir(spark)   # the session's spark.checkpoint.dir; a private folder only when unset
    from souk.plans.registry import load_all
    reg = load_all()
    keys = [k for k in HEADLINE if k in reg]
    # Warm-up: JVM start, parquet footers, Python worker pool (not timed).
    reg["agg_06_product_summary"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times, first = {}, {}
    for k in keys:
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            # plan building (including size checks) is part of the measured time
            reg[k].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        first[k] = round(samples[0], 3)
        times[k] = round(sorted(samples)[len(samples) // 2], 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": f"headline_total_median_of_{runs}", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "first_run": first, "first_run_total": round(sum(first.values()), 3),
           "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
