"""Aggregates: hourly statistics, per-host summaries, counts.

All aggregates run as partial (map-side) + final aggregation, so a host that
holds a large share of the rows costs one pre-aggregated row per map task in
the shuffle. Exact percentiles use a two-stage plan (see ``summarize``).
"""

from __future__ import annotations

from datetime import datetime
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwatch import schema as S
from linkwatch.functions.timefns import bucket, ts_literal, window_start
from linkwatch.operators.filters import (
    host_filter,
    hosts_filter,
    lost,
    range_minutes,
    received,
    since,
    since_hours,
)


def host_list(spark, hosts: Iterable[str]) -> DataFrame:
    """A one-column ``target_host`` DataFrame built JVM-side from a driver list."""
    hs = list(dict.fromkeys(hosts))
    return spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in hs])).alias(S.HOST))


def _loss_rate(losses: Column, total: Column) -> Column:
    return F.try_divide(losses.cast("double"), total.cast("double"))


def hourly_stats(
    pm: DataFrame,
    as_of: datetime,
    hours: float | None = 24,
    host: str | None = None,
    unit: str = "hour",
    sort: bool = False,
) -> DataFrame:
    """Per (bucket, host): mean response, probe count, loss rate in **percent**.

    Columns: ``hour_bucket, target_host, avg_response_time, packet_count,
    packet_loss_rate``. ``unit='day'`` gives daily buckets. ``sort`` adds the
    API order (bucket descending, host ascending).
    """
    rows = host_filter(since_hours(pm, as_of, hours), host)
    out = rows.groupBy(bucket(S.TS, unit).alias("hour_bucket"), F.col(S.HOST)).agg(
        F.avg(S.RT).alias("avg_response_time"),
        F.count(F.lit(1)).alias("packet_count"),
        F.count_if(lost()).alias("_losses"),
    )
    out = out.select(
        "hour_bucket",
        S.HOST,
        "avg_response_time",
        "packet_count",
        (_loss_rate(F.col("_losses"), F.col("packet_count")) * F.lit(100.0)).alias("packet_loss_rate"),
    )
    if sort:
        out = out.orderBy(F.desc("hour_bucket"), F.asc(S.HOST))
    return out


def avg_response_time_by_hour(pm: DataFrame, as_of: datetime, host: str | None = None) -> DataFrame:
    """Hourly statistics over the fixed 7-day window, optional host."""
    return hourly_stats(pm, as_of, hours=168, host=host, unit="hour")


#: Cells of values for each factor of e: a cell's values differ by an eight-thousandth at most.
CELLS = 8192
#: Numbers of cells lie within this, either way; that of lost probes is above all.
_SPAN = 1 << 24
_LOST = 1 << 30


def _cell(v: str) -> str:
    """SQL of a number that never falls as the value of column ``v`` rises: its logarithm in steps.

    It doesn't depend on the values there are: one that is far from all others
    leaves their cells as they are. Lost probes (null) have a cell of their own.
    """
    k = f"least(coalesce(floor(ln(abs({v})) * {CELLS}), -{_SPAN}), {_SPAN})"
    return f"CAST(CASE WHEN {v} IS NULL THEN {_LOST} WHEN isnan({v}) THEN {4 * _SPAN} WHEN {v} < 0 THEN -{k} - {2 * _SPAN} ELSE {k} + {2 * _SPAN} END AS BIGINT)"


def summarize(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probe summary per ``keys``: counts, mean/min/max, exact median and p95
    (linear interpolation, NULLs ignored), losses, loss fraction, first/last.

    Grouping by ``keys + response_time_ms`` first spreads a hot key over all
    reducers. The values of that histogram are counted by cell; running counts
    over the cells of a key tell which hold a wanted rank, and only these are
    ranked value by value. The two readers of the histogram use all its columns,
    so they share one scan and one exchange. A task ranks the values of a cell,
    and one row for each cell of a key (some hundred thousand for times from
    microseconds to minutes), never a key's values.
    """
    # Expressions as SQL: each Column operation is a call to the JVM, and here are many.
    names = list(keys)
    key = ", ".join(f"`{k}`" for k in names)
    hist = rows.groupBy(*names, S.RT).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(lost()).alias("_losses"), F.min(S.TS).alias("_first"), F.max(S.TS).alias("_last")
    )
    hist = hist.withColumn("_cell", F.expr(f"coalesce({_cell(S.RT)}, {_LOST})"))
    cells = hist.groupBy(*names, "_cell").agg(
        F.expr("sum(_n) AS _n"),
        F.expr("sum(_losses) AS _losses"),
        F.expr("min(_first) AS _first"),
        F.expr("max(_last) AS _last"),
        F.expr(f"sum({S.RT} * _n) AS _sum"),
        F.expr(f"min({S.RT}) AS _low"),
        F.expr(f"max({S.RT}) AS _high"),
    )
    of_key = f"OVER (PARTITION BY {key})"
    cells = cells.selectExpr(
        *[f"`{k}` AS `_k_{k}`" for k in names],
        "_cell AS _k_cell",
        "_n AS _cell_n",
        f"coalesce(sum(_n) OVER (PARTITION BY {key} ORDER BY _cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
        f"sum(_n) {of_key} AS _total",
        f"coalesce(sum(CASE WHEN _cell <> {_LOST} THEN _n END) {of_key}, 0) AS _known",
        f"sum(_losses) {of_key} AS _all_losses",
        f"min(_first) {of_key} AS _all_first",
        f"max(_last) {of_key} AS _all_last",
        f"sum(_sum) {of_key} AS _all_sum",
        f"min(_low) {of_key} AS _all_low",
        f"max(_high) {of_key} AS _all_high",
    )
    # Ranks below and above the place of each share, among the known values.
    place = {"_q0": "0.5D * (_known - 1)", "_q1": "0.95D * (_known - 1)"}
    holds = lambda rank, at, count: f"({rank} >= {at} AND {rank} < {at} + {count})"
    wanted = " OR ".join(holds(f"{end}({p})", "_before", "_cell_n") for p in place.values() for end in ("floor", "ceil"))
    # Cells with a wanted rank; for a key without a known value that of its lost probes.
    cells = cells.where(f"CASE WHEN _k_cell <> {_LOST} THEN {wanted} ELSE _known = 0 END")
    same = " AND ".join([*(f"`{k}` <=> `_k_{k}`" for k in names), "_cell <=> _k_cell"])
    held = hist.join(cells, F.expr(same))
    inside = f"OVER (PARTITION BY {key}, _cell ORDER BY {S.RT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    held = held.selectExpr("*", f"_before + coalesce(sum(_n) {inside}, 0) AS _at")
    value = lambda rank: f"max(CASE WHEN {holds(rank, '_at', '_n')} THEN {S.RT} END)"
    quantile = lambda p: f"{value(f'floor({p})')} + ({value(f'ceil({p})')} - {value(f'floor({p})')}) * max({p} - floor({p}))"
    # A key's totals stand in each of its rows; its cells' own add nothing to them.
    out = held.groupBy(*names).agg(
        F.expr("max(_total) AS total_pings"),
        F.expr("try_divide(max(_all_sum), max(_known)) AS avg_response_time"),
        F.expr("max(_all_low) AS min_response_time"),
        F.expr("max(_all_high) AS max_response_time"),
        F.expr(f"{quantile(place['_q0'])} AS median_response_time"),
        F.expr(f"{quantile(place['_q1'])} AS p95_response_time"),
        F.expr("greatest(max(_all_losses), max(_losses)) AS packet_losses"),
        F.expr("least(max(_all_first), min(_first)) AS first_ping"),
        F.expr("greatest(max(_all_last), max(_last)) AS last_ping"),
    )
    return out.selectExpr(
        *[f"`{k}`" for k in names],
        "total_pings",
        "avg_response_time",
        "min_response_time",
        "max_response_time",
        "median_response_time",
        "p95_response_time",
        "packet_losses",
        "try_divide(CAST(packet_losses AS DOUBLE), CAST(total_pings AS DOUBLE)) AS packet_loss_rate",
        "first_ping",
        "last_ping",
    )


def _uptime(total: Column, rate: Column) -> Column:
    return F.when(total > F.lit(0), F.lit(100.0) - rate * F.lit(100.0)).otherwise(F.lit(0.0))


def _window_echo(hours: float | None, minutes: float | None, full_history: bool) -> tuple[float | None, float | None]:
    if full_history:
        return None, None
    if hours is None and minutes is None:
        hours = 24
    if minutes is not None:
        return round(minutes / 60, 2), float(minutes)
    return float(hours), float(hours) * 60.0


def host_summary(
    pm: DataFrame,
    as_of: datetime,
    hours: float | None = None,
    minutes: float | None = None,
    hosts: Iterable[str] | None = None,
    full_history: bool = False,
) -> DataFrame:
    """One row per host: the reliability summary with uptime percent.

    The window is ``minutes`` if given, else ``hours`` (default 24), or the
    whole table with ``full_history``. The loss rate is a **fraction** (0-1).
    With ``hosts`` every requested host gets a row, also one without probes
    (``total_pings = 0``, aggregates NULL, ``uptime_percentage = 0``).
    """
    h_echo, m_echo = _window_echo(hours, minutes, full_history)
    rows = pm
    if not full_history:
        rows = since(pm, window_start(as_of, hours=h_echo, minutes=minutes))
    req = [h for h in (hosts or []) if h]
    rows = hosts_filter(rows, req)
    summ = summarize(rows, [S.HOST])
    if req:
        summ = host_list(pm.sparkSession, req).join(summ, on=S.HOST, how="left")
    return summ.select(
        F.col(S.HOST).alias("host"),
        F.coalesce("total_pings", F.lit(0)).cast("long").alias("total_pings"),
        "avg_response_time",
        "min_response_time",
        "max_response_time",
        "median_response_time",
        "p95_response_time",
        F.coalesce("packet_losses", F.lit(0)).cast("long").alias("packet_losses"),
        "packet_loss_rate",
        "first_ping",
        "last_ping",
        F.lit(h_echo).cast("double").alias("hours_analyzed"),
        F.lit(m_echo).cast("double").alias("minutes_analyzed"),
        _uptime(F.coalesce("total_pings", F.lit(0)), F.col("packet_loss_rate")).alias("uptime_percentage"),
    )


def overall_summary(pm: DataFrame, as_of: datetime, hours: float | None = None, minutes: float | None = None,
                    full_history: bool = False) -> DataFrame:
    """The summary over all hosts together (one row)."""
    rows = pm if full_history else since(pm, window_start(as_of, hours=hours or (None if minutes else 24), minutes=minutes))
    # One key for all rows; not a literal, on which joins would turn into nested loops.
    one = F.coalesce(F.least(F.length(S.HOST), F.lit(0)), F.lit(0))
    summ = summarize(rows.withColumn("_all", one), ["_all"])
    return summ.drop("_all").select(
        "*", _uptime(F.col("total_pings"), F.col("packet_loss_rate")).alias("uptime_percentage")
    )


def summary_by_range(pm: DataFrame, as_of: datetime, presets: Sequence[str] = ("1hr", "1d", "1w")) -> DataFrame:
    """Host summaries for every dashboard range preset in one pass.

    Each row is tagged with the presets whose window contains it (at most
    ``len(presets)`` copies), then summarised per ``(range_preset, host)``.
    """
    tags = [(p, as_of_minus(as_of, range_minutes(p))) for p in presets]
    widest = min(t for _, t in tags)
    rows = since(pm, widest)
    member = F.array_compact(
        F.array(*[F.when(F.col(S.TS) >= ts_literal(t), F.lit(p)) for p, t in tags])
    )
    tagged = rows.select("*", F.explode(member).alias("range_preset"))
    summ = summarize(tagged, ["range_preset", S.HOST])
    return summ.select(
        "range_preset",
        F.col(S.HOST).alias("host"),
        *[c for c in summ.columns if c not in ("range_preset", S.HOST)],
        _uptime(F.col("total_pings"), F.col("packet_loss_rate")).alias("uptime_percentage"),
    )


def as_of_minus(as_of: datetime, minutes: float) -> datetime:
    return window_start(as_of, minutes=minutes)


def metrics_count(pm: DataFrame, as_of: datetime, hours: float | None = None, host: str | None = None) -> DataFrame:
    """Row count with optional window and host (falsy = no filter); column ``count``."""
    rows = host_filter(since_hours(pm, as_of, hours), host)
    return rows.agg(F.count(F.lit(1)).alias("count"))


def distinct_hosts(pm: DataFrame, sort: bool = False) -> DataFrame:
    """Hosts present in the table (column ``target_host``)."""
    out = pm.select(S.HOST).distinct()
    return out.orderBy(S.HOST) if sort else out


def cycle_success(pm: DataFrame, interval: str = "10 seconds") -> DataFrame:
    """Per probe cycle (tumbling window of ``interval``): successful / total probes."""
    w = F.window(S.TS, interval)
    out = pm.groupBy(w.alias("cycle")).agg(
        F.count_if(received()).alias("successful_pings"),
        F.count(F.lit(1)).alias("total_pings"),
    )
    return out.select(
        F.col("cycle.start").alias("cycle_start"),
        F.col("cycle.end").alias("cycle_end"),
        "successful_pings",
        "total_pings",
    )


def live_host_count(pm: DataFrame) -> DataFrame:
    """Number of hosts that have a latest result (column ``live_hosts``)."""
    return pm.agg(F.count_distinct(S.HOST).alias("live_hosts"))
