"""Print a plan audit line per registered batch query.

Usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from linkwatch.plans.audit import audit  # noqa: E402
from linkwatch.plans.catalog import queries  # noqa: E402
from linkwatch.session import build_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("local[4]", shuffle_partitions=8)
    for name, fn in queries().items():
        if name.startswith("stream_"):
            continue  # streams are read back from their sinks
        print(json.dumps({"query": name, **audit(fn(spark, sf_dir))}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
