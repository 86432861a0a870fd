"""The request boundary: parameter ranges of the public API.

Operators take any window; requests that come in from outside go through
``request``, which checks the ranges first.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from linkwatch.operators import downtime, filters, latest, stats
from linkwatch.operators.filters import validate_params

REQUESTS = {
    "recent_metrics": latest.recent_metrics,
    "hourly_stats": stats.hourly_stats,
    "host_summary": stats.host_summary,
    "metrics_count": stats.metrics_count,
    "downtime_periods": downtime.downtime_periods,
    "affected_pings": downtime.affected_pings,
    "retention_count": filters.retention_count,
    "retention_expired": filters.retention_expired,
}


def request(name: str, pm: DataFrame, as_of: datetime, **params) -> DataFrame:
    """Answer of the named operator, or ``ValueError`` for an unknown name or a
    parameter out of range (``filters.LIMITS``)."""
    if name not in REQUESTS:
        raise ValueError(f"unknown request {name!r}")
    validate_params(**params)
    return REQUESTS[name](pm, as_of, **params)
