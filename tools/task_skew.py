"""Read a Spark event log folder (as written with BENCH_EVENTLOG_DIR) and report, per stage,
the slowest task against the median task - a quick way to spot skewed stages.

usage: python tools/task_skew.py EVENTLOG_DIR [top-n]
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys


def _lines(path):
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main():
    root = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    files = sorted(glob.glob(os.path.join(root, "**", "events_*"), recursive=True)) or \
        sorted(p for p in glob.glob(os.path.join(root, "*")) if os.path.isfile(p))
    tasks, names = collections.defaultdict(list), {}
    for f in files:
        for line in _lines(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd":
                ti = e["Task Info"]
                tasks[e["Stage ID"]].append(ti["Finish Time"] - ti["Launch Time"])
            elif e["Event"] == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                names[si["Stage ID"]] = si["Stage Name"]
    rows = []
    for sid, ts in tasks.items():
        ts = sorted(ts)
        med = ts[len(ts) // 2]
        rows.append((ts[-1] / max(med, 1), sid, len(ts), med, ts[-1], names.get(sid, "")))
    rows.sort(reverse=True)
    print(f"{len(rows)} stages; worst max/median task time:")
    for ratio, sid, n, med, mx, name in rows[:top]:
        print(f"  stage {sid:5d}  tasks {n:5d}  median {med:6d} ms  max {mx:6d} ms  ratio {ratio:6.1f}  {name[:60]}")


if __name__ == "__main__":
    main()
