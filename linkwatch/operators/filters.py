"""Row filters and projections over the fact table.

All predicates are plain column comparisons against driver-side literals so
Catalyst pushes them into the Parquet scan (``PushedFilters``); when the
input carries the ``metric_date`` partition column the time bound is also
applied to it, which prunes whole date folders.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwatch import schema as S
from linkwatch.functions.timefns import ts_literal, window_start

# Parameter ranges accepted by the public query surface.
LIMITS = {
    "hours": (1, 168),
    "minutes": (1, 10080),
    "limit": (1, 10000),
    "offset": (0, None),
    "min_duration_seconds": (1, None),
    "days": (1, 365),
}


def validate_params(**params) -> None:
    """Range-check query parameters before any plan is built (``ValueError``)."""
    for name, value in params.items():
        if value is None or name not in LIMITS:
            continue
        lo, hi = LIMITS[name]
        if value < lo or (hi is not None and value > hi):
            raise ValueError(f"{name}={value} outside [{lo}, {hi if hi is not None else 'inf'}]")


def since(pm: DataFrame, start: datetime | None) -> DataFrame:
    """Rows with ``timestamp >= start`` (inclusive); ``None`` keeps all rows."""
    if start is None:
        return pm
    out = pm
    if S.METRIC_DATE in pm.columns:
        out = out.where(F.col(S.METRIC_DATE) >= F.lit(start.date()))
    return out.where(F.col(S.TS) >= ts_literal(start))


def between(rows: DataFrame, time: str, begin: datetime | None, end: datetime | None) -> DataFrame:
    """Rows with ``begin <= time < end``, by whole dates too on a stored table; ``None`` sets no bound."""
    dated = S.METRIC_DATE in rows.columns
    if begin is not None:
        rows = rows.where(F.col(S.METRIC_DATE) >= F.lit(begin.date())) if dated else rows
        rows = rows.where(F.col(time) >= ts_literal(begin))
    if end is not None:
        rows = rows.where(F.col(S.METRIC_DATE) <= F.lit(end.date())) if dated else rows
        rows = rows.where(F.col(time) < ts_literal(end))
    return rows


def since_hours(pm: DataFrame, as_of: datetime, hours: float | None) -> DataFrame:
    """Look-back window in hours; falsy ``hours`` means the full history."""
    return since(pm, window_start(as_of, hours=hours))


def since_minutes(pm: DataFrame, as_of: datetime, minutes: float | None) -> DataFrame:
    """Look-back window in minutes; falsy ``minutes`` means the full history."""
    return since(pm, window_start(as_of, minutes=minutes))


def host_filter(pm: DataFrame, host: str | None = None) -> DataFrame:
    """Equality on the host; ``None`` or ``""`` keeps every host."""
    if not host:
        return pm
    return pm.where(F.col(S.HOST) == F.lit(host))


def hosts_filter(pm: DataFrame, hosts: Iterable[str] | None) -> DataFrame:
    hosts = [h for h in (hosts or []) if h]
    if not hosts:
        return pm
    return pm.where(F.col(S.HOST).isin(hosts))


def metric_by_id(pm: DataFrame, metric_id: int) -> DataFrame:
    """Point lookup by id (at most one row; empty when absent)."""
    return pm.where(F.col(S.ID) == F.lit(metric_id)).select(*S.METRIC_COLUMNS).limit(1)


def lost(col: str = S.LOSS):
    """``packet_loss = TRUE`` (NULL is not a loss)."""
    return F.col(col) == F.lit(True)


def received(col: str = S.LOSS):
    """``packet_loss = FALSE`` (NULL is not a success either)."""
    return F.col(col) == F.lit(False)


def dns_only(pm: DataFrame, host_col: str = S.HOST) -> DataFrame:
    """Rows of the DNS resolver hosts only."""
    return pm.where(F.col(host_col).isin(*S.DNS_HOSTS))


def watchlist_filter(pm: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Keep rows of watched hosts (left-semi join on ``target_host``).

    The watchlist is a user-maintained dimension; the join strategy is left
    to Spark/AQE, which broadcasts it only after measuring its size.
    """
    return pm.join(watchlist.select(S.HOST), on=S.HOST, how="left_semi")


def retention_cutoff(as_of: datetime, days: int = 30) -> datetime:
    return as_of - timedelta(days=days)


def retention_keep(pm: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Rows that survive a ``days`` retention: ``timestamp >= cutoff``."""
    return since(pm, retention_cutoff(as_of, days))


def retention_expired(pm: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Rows a ``days`` retention deletes: ``timestamp < cutoff`` (complement of keep)."""
    cut = retention_cutoff(as_of, days)
    out = pm
    if S.METRIC_DATE in pm.columns:
        out = out.where(F.col(S.METRIC_DATE) <= F.lit(cut.date()))
    return out.where(F.col(S.TS) < ts_literal(cut))


def retention_count(pm: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Number of rows a retention run deletes (one row, column ``deleted_count``)."""
    return retention_expired(pm, as_of, days).agg(F.count(F.lit(1)).alias("deleted_count"))


def project_view(pm: DataFrame) -> DataFrame:
    """The 5-column projection of the recent view."""
    return pm.select(S.TS, S.HOST, S.RT, S.LOSS, S.ERR)


def recent_view(pm: DataFrame, as_of: datetime, hours: float = 24, name: str | None = None) -> DataFrame:
    """Last ``hours`` of rows, 5 columns; optionally registered as a temp view.

    Order (newest first) is applied by readers, not stored in the view.
    """
    out = project_view(since_hours(pm, as_of, hours))
    if name:
        out.createOrReplaceTempView(name)
    return out


def range_minutes(preset: str) -> int:
    """Dashboard preset -> look-back minutes."""
    try:
        return S.RANGE_PRESETS[preset]
    except KeyError:
        raise ValueError(f"unknown range preset {preset!r}; use one of {sorted(S.RANGE_PRESETS)}") from None


def chart_series(pm: DataFrame, as_of: datetime, host: str | None = None, preset: str = "1hr") -> DataFrame:
    """Chart points: answered probes in the preset window, time label, ascending.

    Columns: ``target_host, timestamp, time, response_time, id``; ``time`` is
    ``HH:mm:ss`` in the session zone (UTC).
    """
    rows = host_filter(since_minutes(pm, as_of, range_minutes(preset)), host)
    return (
        rows.where(F.col(S.RT).isNotNull())
        .select(
            S.HOST,
            S.ID,
            F.col(S.TS),
            F.date_format(F.col(S.TS), "HH:mm:ss").alias("time"),
            F.col(S.RT).alias("response_time"),
        )
        .orderBy(S.TS, S.ID)
    )


def duplicate_keys(pm: DataFrame) -> DataFrame:
    """Data-quality check for the table key ``(id, timestamp)``: every key that
    occurs more than once, with its count (``duplicates``). Empty when the
    key is unique. A partial + final hash aggregate on the key."""
    return (
        pm.groupBy(S.ID, S.TS)
        .agg(F.count(F.lit(1)).alias("duplicates"))
        .where(F.col("duplicates") > F.lit(1))
    )
