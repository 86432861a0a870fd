"""Recency: latest row per host, newest-first pages, current response time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwatch import schema as S
from linkwatch.functions.timefns import bucket, ts_literal
from linkwatch.operators.filters import between, chart_series, host_filter, since_hours, since_minutes


def _order_key():
    return F.struct(F.col(S.TS), F.col(S.ID))


def latest_per_host(pm: DataFrame, method: str = "semi_join") -> DataFrame:
    """Newest row of every host (ties on timestamp broken by the larger id).

    ``semi_join`` (default) stays on hash operators: a narrow
    ``max(timestamp)`` per host (partial + final hash aggregate over two
    columns), a semi join of the rows onto those maxima (one row per host on
    the build side; AQE broadcasts it after measuring it), and the id
    tie-break over the few candidate rows. ``max_by`` is the one-pass form;
    its struct buffer makes Spark sort every map partition (sort aggregate).
    """
    cols = [c for c in S.METRIC_COLUMNS if c in pm.columns]
    if method == "semi_join" and S.METRIC_DATE in pm.columns:
        return latest_rows(pm.select(*cols, S.METRIC_DATE)).drop(S.METRIC_DATE)
    if method == "max_by":
        latest = pm.groupBy(S.HOST).agg(F.max_by(F.struct(*cols), _order_key()).alias("_row"))
        return latest.select(*[F.col(f"_row.{c}").alias(c) for c in cols])
    if method != "semi_join":
        raise ValueError("method must be 'semi_join' or 'max_by'")
    return latest_rows(pm.select(*cols))


def latest_rows(df: DataFrame, key: str = S.HOST, ts: str = S.TS, tie: str = S.ID) -> DataFrame:
    """Row with the greatest ``(ts, tie)`` per ``key``, on hash operators:
    max ``ts`` per key, semi join back, then the tie-break over candidates.

    Building the plan runs nothing. On a stored table (``metric_date`` partitions)
    the date of the newest row is part of the join key, so Spark can prune the
    date folders of the second scan at run time.
    """
    newest = df.groupBy(F.col(key).alias("_k")).agg(F.max(ts).alias("_t"))
    rows = df
    cond = (F.col(key) == F.col("_k")) & (F.col(ts) == F.col("_t"))
    if S.METRIC_DATE in df.columns:
        cond = cond & (F.col(S.METRIC_DATE) == F.to_date("_t"))
    cand = rows.join(newest, cond, "left_semi")
    w = Window.partitionBy(key).orderBy(F.desc(tie))
    return cand.select("*", F.row_number().over(w).alias("_rn")).where(F.col("_rn") == 1).drop("_rn")


def latest_per_host_rank(pm: DataFrame) -> DataFrame:
    """Same result as ``latest_per_host`` via ``row_number() = 1``
    (planned as a window-group limit on both sides of the shuffle)."""
    w = Window.partitionBy(S.HOST).orderBy(F.desc(S.TS), F.desc(S.ID))
    cols = [c for c in S.METRIC_COLUMNS if c in pm.columns]
    return pm.select(*cols, F.row_number().over(w).alias("_rn")).where(F.col("_rn") == 1).drop("_rn")


def latest_metric(pm: DataFrame, host: str) -> DataFrame:
    """Newest row of one host (at most one row)."""
    cols = [c for c in S.METRIC_COLUMNS if c in pm.columns]
    return host_filter(pm, host).select(*cols).orderBy(F.desc(S.TS), F.desc(S.ID)).limit(1)


def recent_metrics(
    pm: DataFrame,
    as_of: datetime,
    hours: float | None = 24,
    host: str | None = None,
    limit: int = 1000,
    offset: int = 0,
    cap: int | None = None,
    minutes: float | None = None,
) -> DataFrame:
    """Newest rows first: the page ``[offset, offset + limit)``. With ``cap`` it is
    cut from the newest ``cap`` rows only (so ``offset >= cap`` is empty).
    ``minutes`` (the time-range form) replaces ``hours`` when given.

    Planned as a top-k (``TakeOrderedAndProject``): each task keeps its best
    ``offset + limit`` rows, only those reach the final merge.
    """
    cols = [c for c in S.METRIC_COLUMNS if c in pm.columns]
    if minutes is not None:
        rows = host_filter(since_minutes(pm, as_of, minutes), host).select(*cols)
    else:
        rows = host_filter(since_hours(pm, as_of, hours), host).select(*cols)
    ordered = rows.orderBy(F.desc(S.TS), F.desc(S.ID))
    if cap is not None:
        ordered = ordered.limit(cap)
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


#: Time units by which a page is found, each within one of the unit before.
PAGE_UNITS = ("day", "hour", "minute", "second")


def _find(rows: DataFrame, position: int, hourly: DataFrame | None) -> tuple[datetime, datetime, int] | None:
    """(begin, end, newer): the second that holds the ``position``-th row, newest first, and the rows after it; None beyond the last row."""
    begin = end = None
    newer = 0
    for unit in PAGE_UNITS:
        if hourly is not None and unit in ("day", "hour"):
            source, time, n = hourly, "hour_bucket", F.sum("probes")
        else:
            source, time, n = rows, S.TS, F.count(F.lit(1))
        if begin is not None:
            source = between(source, time, begin, end)
        counts = source.groupBy(bucket(time, unit).alias("at")).agg(n.alias("n"))
        # One row for each unit within the one above, or for each date.
        upto = Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.lit(newer) + F.sum("n").over(upto)).where(F.col("upto") > position)
        hit = counts.orderBy(F.desc("at")).limit(1).collect()
        if not hit:
            return None
        begin, newer = hit[0]["at"], hit[0]["upto"] - hit[0]["n"]
        end = begin + timedelta(**{f"{unit}s": 1})
    return begin, end, newer


def metrics_page(pm: DataFrame, offset: int, limit: int, host: str | None = None, hourly: DataFrame | None = None) -> DataFrame:
    """The page ``[offset, offset + limit)`` of all rows, newest first, without sorting what is newer.

    Counts by date, hour, minute and second find where the page begins and ends
    (a few small jobs as the plan is built, each within the unit found before);
    only rows of that range are sorted, so a task and the driver hold a page and
    a second's rows, whatever the offset. ``hourly`` (a ``Rollup``'s rows) saves
    the counts of dates and hours.
    """
    cols = [c for c in S.METRIC_COLUMNS if c in pm.columns]
    rows = host_filter(pm, host)
    hourly = host_filter(hourly, host) if hourly is not None else None
    first = _find(rows, offset, hourly) if limit > 0 else None
    if first is None:
        return rows.select(*cols).where("false")
    last = _find(rows, offset + limit - 1, hourly)
    page = between(rows, S.TS, last[0] if last else None, first[1]).select(*cols)
    return page.orderBy(F.desc(S.TS), F.desc(S.ID)).offset(offset - first[2]).limit(limit)


def next_page(pm: DataFrame, after: tuple[datetime, int], limit: int, host: str | None = None) -> DataFrame:
    """The ``limit`` rows that follow the row with time and id ``after``, newest first."""
    ts, metric_id = ts_literal(after[0]), F.lit(after[1])
    older = between(pm, S.TS, None, after[0] + timedelta(microseconds=1))
    return metrics_page(older.where((F.col(S.TS) < ts) | (F.col(S.ID) < metric_id)), 0, limit, host)


def current_response(pm: DataFrame, as_of: datetime, preset: str = "1hr", host: str | None = None) -> DataFrame:
    """Latest answered response time per host within the chart window,
    with its display label ``%.1fms`` (columns ``target_host,
    current_response_time, current_response_label``)."""
    pts = chart_series(pm, as_of, host=host, preset=preset).select(S.HOST, S.TS, S.ID, "response_time")
    cur = latest_rows(pts).select(S.HOST, F.col("response_time").alias("current_response_time"))
    return cur.select(
        S.HOST,
        "current_response_time",
        F.format_string("%.1fms", F.col("current_response_time")).alias("current_response_label"),
    )


#: Hosts of a map or of a message's part, about.
HOSTS_TOGETHER = 1000


def shard_count(rows: DataFrame, host: str = S.HOST) -> int:
    """Shards that give each about HOSTS_TOGETHER hosts: one small job counts the hosts, within a few per cent."""
    n = rows.agg(F.approx_count_distinct(host)).first()[0]  # one number
    return max(1, -(-n // HOSTS_TOGETHER))


def latest_map(pm: DataFrame, shards: int | None = None) -> DataFrame:
    """Host -> latest row as a map (the API's response shape).

    The latest rows (one per host) are grouped into maps by a hash of the host.
    Without ``shards`` their number follows the hosts (``shard_count``, a job as the
    plan is built), so a map holds about HOSTS_TOGETHER entries however many hosts
    there are. Columns: ``shard, latest``.
    """
    rows = latest_per_host(pm)
    cols = [c for c in rows.columns]
    shard = F.pmod(F.xxhash64(S.HOST), F.lit(shard_count(pm) if shards is None else int(shards))).alias("shard")
    return rows.groupBy(shard).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(S.HOST), F.struct(*cols)))).alias("latest")
    )
