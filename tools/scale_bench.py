"""Time the headline queries on time-shifted copies of the fixture table.

The fact table derived from ``events`` is replicated ``k`` times by Spark
(copy ``c`` shifted by ``c * 30`` days, ids offset), stored in the package's
layout (``metric_date`` partitions, host/time clustered) under a scratch
folder, then read back with ``scan_metrics``.

Usage: [SCALE_MODE=time|hosts] python tools/scale_bench.py SF_DIR SCRATCH_DIR K [K ...]
Prints one JSON line per K.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from datetime import timedelta

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from linkwatch import schema as S  # noqa: E402
from linkwatch.operators import downtime as D  # noqa: E402
from linkwatch.operators import latest as L  # noqa: E402
from linkwatch.operators import stats as A  # noqa: E402
from linkwatch.session import build_session  # noqa: E402
from linkwatch.sources.metrics import append_metrics, load_pm, scan_metrics  # noqa: E402

SHIFT_DAYS = 30


def replicate(pm, k: int, mode: str = "time"):
    """``time``: copy c is shifted by c * 30 days (longer history);
    ``hosts``: copy c keeps the time span and gets its own host names
    (``host#c``), i.e. k times more hosts probed in the same period."""
    n_ids = pm.agg(F.max(S.ID)).first()[0] + 1
    c = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_c")
    rep = pm.select("*", c)
    if mode == "hosts":
        return rep.select(
            (F.col(S.ID) + F.col("_c").cast("long") * F.lit(n_ids)).alias(S.ID),
            S.TS,
            F.when(F.col("_c") == 0, F.col(S.HOST)).otherwise(F.concat_ws("#", S.HOST, F.col("_c").cast("string"))).alias(S.HOST),
            S.RT,
            S.LOSS,
            S.ERR,
            S.CREATED,
        )
    shift = F.make_dt_interval(F.col("_c") * F.lit(SHIFT_DAYS))
    return rep.select(
        (F.col(S.ID) + F.col("_c").cast("long") * F.lit(n_ids)).alias(S.ID),
        (F.col(S.TS) + shift).alias(S.TS),
        S.HOST,
        S.RT,
        S.LOSS,
        S.ERR,
        (F.col(S.CREATED) + shift).alias(S.CREATED),
    )


def main(argv):
    sf_dir, scratch = argv[1], argv[2]
    mode = os.environ.get("SCALE_MODE", "time")
    ks = [int(x) for x in argv[3:]] or [10]
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, extra={"spark.driver.memory": "8g"})
    base = load_pm(spark, sf_dir)
    for k in ks:
        path = f"{scratch}/pm_{mode}_x{k}"
        if not os.path.exists(path):
            append_metrics(replicate(base, k, mode), path)
        pm = scan_metrics(spark, path)
        rows = pm.count()
        as_of = S.FIXTURE_AS_OF + timedelta(days=SHIFT_DAYS * (k - 1) if mode == "time" else 0)
        qs = {
            "downtime_periods": lambda: D.downtime_periods(pm, as_of, hours=None, min_duration_seconds=30),
            "host_summary": lambda: A.host_summary(pm, as_of, full_history=True),
            "hourly_stats": lambda: A.hourly_stats(pm, as_of, hours=None),
            "recent_metrics": lambda: L.recent_metrics(pm, as_of, hours=168),
            "latest_per_host": lambda: L.latest_per_host(pm),
        }
        out = {}
        for name, fn in qs.items():
            def once():
                t0 = time.perf_counter()
                fn().write.format("noop").mode("overwrite").save()
                return time.perf_counter() - t0

            once()
            out[name] = round(statistics.median(once() for _ in range(3)), 3)
        print(json.dumps({"mode": mode, "k": k, "rows": rows, "queries": out, "total": round(sum(out.values()), 3)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
