"""linkwatch: network reliability analytics on Spark.

Public entry points (all take and return DataFrames):

* sources:   ``load_pm``, ``scan_metrics``, ``append_metrics``, ``apply_retention``,
             ``normalize_probe``, ``apply_defaults``, ``assign_ids``, ``parse_probe_json``,
             ``provider_info``
* filters:   ``since_hours``, ``since_minutes``, ``host_filter``, ``dns_only``,
             ``watchlist_filter``, ``retention_keep``, ``retention_expired``, ``chart_series``,
             ``duplicate_keys``
* stats:     ``hourly_stats``, ``host_summary``, ``overall_summary``, ``summary_by_range``,
             ``metrics_count``, ``distinct_hosts``, ``cycle_success``, ``live_host_count``
* recency:   ``latest_per_host``, ``latest_rows``, ``latest_map``, ``recent_metrics``,
             ``latest_metric``, ``current_response``
* outages:   ``downtime_periods``, ``downtime_by_hour``, ``downtime_totals``,
             ``downtime_report``, ``event_ordinal``, ``affected_pings``
* streaming: ``linkwatch.streaming.jobs``
"""

from linkwatch.operators.downtime import (  # noqa: F401
    affected_pings,
    downtime_by_hour,
    downtime_periods,
    downtime_report,
    downtime_totals,
    event_ordinal,
)
from linkwatch.operators.filters import (  # noqa: F401
    chart_series,
    dns_only,
    duplicate_keys,
    host_filter,
    retention_expired,
    retention_keep,
    since_hours,
    since_minutes,
    watchlist_filter,
)
from linkwatch.operators.latest import (  # noqa: F401
    current_response,
    latest_map,
    latest_metric,
    latest_per_host,
    latest_rows,
    recent_metrics,
)
from linkwatch.operators.stats import (  # noqa: F401
    cycle_success,
    distinct_hosts,
    host_summary,
    hourly_stats,
    live_host_count,
    metrics_count,
    overall_summary,
    summary_by_range,
)
from linkwatch.sources.ingest import (  # noqa: F401
    apply_defaults,
    assign_ids,
    normalize_probe,
    parse_probe_json,
    provider_info,
)
from linkwatch.sources.metrics import (  # noqa: F401
    append_metrics,
    apply_retention,
    load_pm,
    scan_metrics,
)

__version__ = "0.1.0"
