"""Every registered query runs on an empty events table."""

from __future__ import annotations

import pytest

from linkwatch.plans.catalog import queries
from linkwatch.sources.metrics import EVENTS_SCHEMA

QUERIES = queries()
# queries whose answer has rows even without probes (counts, requested hosts, watchlists)
NON_EMPTY = {
    "metrics_count",
    "metrics_count_filtered",
    "live_host_count",
    "retention_count",
    "host_summary",
    "host_inventory",
    "watchlist_add",
    "overall_summary",
}


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], EVENTS_SCHEMA).write.parquet(str(d / "events.parquet"))
    return str(d)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_on_empty(spark, empty_dir, name):
    n = QUERIES[name](spark, empty_dir).count()
    if name not in NON_EMPTY:
        assert n == 0
