"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is run ``$BENCH_WARMUP`` (2) times to warm up, then ``$BENCH_RUNS`` (5) times; the median
wall-clock time of a full evaluation (result written to a no-op sink) is
reported.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "downtime_periods",
    "host_summary",
    "hourly_stats",
    "recent_metrics",
    "latest_per_host",
    "summary_by_range",
    "downtime_by_hour",
    "cycle_success",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    warmup = int(os.environ.get("BENCH_WARMUP", "2"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    from linkwatch.plans.catalog import queries
    from linkwatch.session import build_session

    spark = build_session(
        master=f"local[{cpus}]",
        app_name="linkwatch-bench",
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
        extra={
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
            "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
        },
    )
    qs = queries()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    def once(fn) -> float:
        t0 = time.perf_counter()
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    # Warm up every query first (JIT, codegen caches) so the timed order
    # does not favour later queries.
    for _ in range(warmup):
        for name in HEADLINE:
            once(qs[name])
    for name in HEADLINE:
        fn = qs[name]
        times[name] = round(statistics.median(once(fn) for _ in range(runs)), 4)
        rows[name] = fn(spark, sf_dir).count()
    total = round(sum(times.values()), 4)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_median",
                "value": total,
                "unit": "sec",
                "queries": times,
                "rows": rows,
                "sf": sf,
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    from linkwatch.session import drop_scratch

    drop_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
