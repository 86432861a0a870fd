"""Physical-plan audit: operators that do not scale, counted per query."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Operators a registered query must not contain.
FORBIDDEN = ("SortAggregate", "CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def audit(df: DataFrame) -> dict:
    """Counts of exchanges and joins, and any forbidden operator, in ``df``'s plan."""
    p = plan_text(df)
    return {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", p)),
        "single_partition": p.count("Exchange SinglePartition"),
        "broadcasts": p.count("BroadcastExchange"),
        "sort_merge_joins": p.count("SortMergeJoin"),
        "windows": len(re.findall(r"\bWindow\b", p)),
        "pushed_filters": "PushedFilters: [" in p and "PushedFilters: []" not in p,
        "forbidden": [op for op in FORBIDDEN if op in p],
    }
