"""Benchmark: the cleaning build plus the headline queries over the driver
tables at $BENCH_SF_DIR on local[$BENCH_CPUS]. Prints one JSON line.

``build`` is the full cleaning chain (adapter joins, row-level cleaning,
dedup shuffle, the written stage, medians and limits, flag gate). Every
other entry is one registered query over that build, timed to a collected
result. ``value`` is the sum of all entries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "kpis",
    "carrier_spend",
    "kpis_by_segment_month",
    "trend_week",
    "lane_matrix",
    "weekday_effects",
    "worst_lanes",
    "kpi_change",
    "cleaning_log",
    "findings",
    "executive_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from shipledger.plans import build
    from shipledger.plans.registry import QUERIES
    from shipledger.session import get_spark

    spark = get_spark(f"local[{cpus}]", partitions=int(cpus))
    # JVM warm-up, not timed and reported separately: one pass of the same
    # build and queries over the smallest fixture, so the timed pass measures
    # steady-state work rather than the JIT compiling generated code (a fixed
    # cost per JVM, ~5x slower first runs here, independent of data size).
    t0 = time.perf_counter()
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if Path(warm_dir).is_dir() and Path(warm_dir).resolve() != Path(sf_dir).resolve():
        build.processed(spark, warm_dir).table.count()
        for name in HEADLINE:
            QUERIES[name](spark, warm_dir).collect()
    warmup = time.perf_counter() - t0

    times: dict[str, float] = {}
    t0 = time.perf_counter()
    built = build.processed(spark, sf_dir)
    times["build"] = time.perf_counter() - t0
    rows_out = built.table.count()

    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        times[name] = time.perf_counter() - t0

    sf = Path(sf_dir).name.replace("sf", "")
    print(json.dumps({
        "metric": "build_plus_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "rows_out": rows_out,
        "cpus": int(cpus),
        "warmup_sec": round(warmup, 3),
        "warmup_dir": warm_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
