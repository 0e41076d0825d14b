"""Summarise the physical plans of the headline queries: shuffles, broadcasts, sort-based
aggregates, partial top-k limits and pushed filters (from the executed adaptive plan)."""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bench import HEADLINE  # noqa: E402
from souk.plans.registry import load_all  # noqa: E402
from souk.session import checkpoint_dir, get_spark  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=16)
    checkpoint_dir(spark)
    reg = load_all()
    print("| Query | Shuffles | Broadcasts | Codegen stages | Sort aggregates | Partial top-k | Pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for k in (sys.argv[2:] or HEADLINE):
        df = reg[k].build(spark, sf_dir)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()        # run this plan itself so the adaptive plan is final
        ex = qe.executedPlan()
        try:                      # AdaptiveSparkPlanExec: take the final plan only
            ex = ex.executedPlan()
        except Exception:         # noqa: BLE001 - not adaptive
            pass
        plan = ex.toString()
        # the executed adaptive plan lists the final stages; reused exchanges are counted once
        shuffles = len(re.findall(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition", plan))
        bcast = len(re.findall(r"BroadcastExchange", plan))
        codegen = len(set(re.findall(r"\*\((\d+)\)", plan)))
        sortagg = len(re.findall(r"SortAggregate", plan))
        wgl = len(re.findall(r"WindowGroupLimit", plan))
        pushed = "yes" if "PushedFilters: [" in plan and "PushedFilters: []" not in plan else "-"
        print(f"| `{k}` | {shuffles} | {bcast} | {codegen} | {sortagg} | {wgl} | {pushed} |")
    spark.stop()


if __name__ == "__main__":
    main()
