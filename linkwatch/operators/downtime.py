"""Outage ("downtime") detection: a gaps-and-islands query over probe flags.

Semantics (per host, rows in ``(timestamp, id)`` order, after the window and
host filters):

* ``prev`` is the previous row's ``packet_loss`` (NULL for the first row);
* a *start* is a row with ``packet_loss = TRUE AND (prev = FALSE OR prev IS NULL)``;
* an *end* is a row with ``packet_loss = FALSE AND prev = TRUE``;
* the n-th start is paired with the n-th end (ordinals per host);
  starts without an end are open and dropped unless ``include_open``;
* ``duration_seconds = end - start``, kept when ``>= min_duration_seconds``.

Distributed plan. A per-host window would put every row of a host into one
task, and one host may hold a large share of all rows. Rows are therefore
windowed per ``(host, chunk)`` where ``chunk`` is a time bucket (default one
hour). Inside a chunk ``lag`` gives the flags of all rows but the first; the
first row's ``prev`` is the last flag of the host's previous non-empty chunk.
Start/end ordinals are local running counts plus the number of starts/ends in
the host's earlier chunks. Both cross-chunk quantities come from a summary
with one row per ``(host, chunk)`` whose size is bounded by the time span /
chunk width, not by the row count. The final pairing is an equi-join on
``(host, ordinal)``, a unique key on each side, so it spreads evenly.

Only "edge" rows (starts, ends, and the first/last row of each chunk) leave
the windowed stage; they are re-partitioned once and that exchange is shared
by the summary and the pairing branch.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwatch import schema as S
from linkwatch.functions.timefns import bucket, epoch_seconds, ts_literal
from linkwatch.operators.filters import host_filter, since_hours
from linkwatch.session import scratch_path

CHUNK = "chunk"
_INT = "int"


def _window_rows(pm: DataFrame, as_of: datetime | None, hours: float | None, host: str | None) -> DataFrame:
    """Filter before any window function (a window that opens mid-outage
    starts the outage at its first row)."""
    rows = host_filter(pm, host)
    if as_of is not None:
        rows = since_hours(rows, as_of, hours)
    elif hours:
        raise ValueError("a look-back window (hours) needs as_of")
    return rows


def loss_transitions(
    pm: DataFrame,
    as_of: datetime | None = None,
    hours: float | None = None,
    host: str | None = None,
    chunk_unit: str = "hour",
    materialize: bool = False,
) -> DataFrame:
    """Every row with its previous flag ``prev_packet_loss`` and edge flags.

    Columns: ``target_host, timestamp, id, packet_loss, prev_packet_loss,
    is_start, is_end``. Computed with the chunked plan (no per-host task).
    """
    edges = _edge_rows(_window_rows(pm, as_of, hours, host), chunk_unit, keep_all=True, persist=materialize)
    summary = _chunk_summary(edges)
    j = edges.join(summary, on=[S.HOST, CHUNK], how="inner")
    prev = F.when(F.col("is_first"), F.col("prev_chunk_last")).otherwise(F.col("prev"))
    return j.select(
        S.HOST,
        S.TS,
        S.ID,
        S.LOSS,
        prev.alias("prev_packet_loss"),
        (F.col("local_start") | (F.col("is_first") & F.col("first_start"))).alias("is_start"),
        (F.col("local_end") | (F.col("is_first") & F.col("first_end"))).alias("is_end"),
    )


def _edge_rows(rows: DataFrame, chunk_unit: str, keep_all: bool = False, persist: bool = False) -> DataFrame:
    """The edge set (see ``edge_frame``). It feeds both the per-chunk summary
    and the numbering: lazily through one reused exchange, or, if the caller
    asks for it, through a table written once to the checkpoint folder."""
    ef = edge_frame(rows, chunk_unit, keep_all)
    return materialize(ef) if persist else ef


def edge_frame(rows: DataFrame, chunk_unit: str = "hour", keep_all: bool = False) -> DataFrame:
    """Window per (host, chunk): local edge flags and running ordinals.

    Keeps starts, ends and the first and last row of every chunk (all rows
    with ``keep_all``). Shuffled by ``(host, chunk)``: one host's history is
    spread over as many tasks as it has chunks.

    Host and time are never null. Saying so here keeps Spark from inferring it
    in one of the two consumers only, after which their plans differ and the
    scan and the exchange would not be shared.
    """
    base = rows.select(S.HOST, S.TS, S.ID, S.LOSS, bucket(S.TS, chunk_unit).alias(CHUNK))
    base = base.where(F.col(S.HOST).isNotNull() & F.col(CHUNK).isNotNull())
    w = Window.partitionBy(S.HOST, CHUNK).orderBy(S.TS, S.ID)
    loss = F.col(S.LOSS)
    prev = F.col("prev")
    stage1 = base.select(
        "*",
        F.lag(S.LOSS).over(w).alias("prev"),
        # lag/lead of a constant are NULL exactly at the chunk's edges
        F.lag(F.lit(1)).over(w).isNull().alias("is_first"),
        F.lead(F.lit(1)).over(w).isNull().alias("is_last"),
    )
    not_first = ~F.col("is_first")
    local_start = not_first & F.coalesce(loss, F.lit(False)) & F.coalesce(~prev, F.lit(True))
    local_end = not_first & F.coalesce((loss == F.lit(False)) & (prev == F.lit(True)), F.lit(False))
    lost = F.coalesce(loss, F.lit(False)).cast("long")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stage2 = stage1.select(
        "*",
        local_start.alias("local_start"),
        local_end.alias("local_end"),
        # losses in the chunk before this row, and in all of it (used by affected_pings)
        F.coalesce(F.sum(lost).over(before), F.lit(0)).cast("long").alias("lost_before"),
        F.sum(lost).over(every).cast("long").alias("n_local_lost"),
    )
    if not keep_all:
        stage2 = stage2.where(
            F.col("local_start") | F.col("local_end") | F.col("is_first") | F.col("is_last")
        )
    # Running ordinals and whole-chunk totals in one more window pass over
    # the same partitioning and order (no extra exchange or sort); dropping
    # non-edge rows first changes neither (they count 0, the last row stays).
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stage3 = stage2.select(
        "*",
        F.sum(F.col("local_start").cast(_INT)).over(running).alias("s_ord"),
        F.sum(F.col("local_end").cast(_INT)).over(running).alias("e_ord"),
        F.sum(F.col("local_start").cast(_INT)).over(whole).cast("long").alias("n_local_start"),
        F.sum(F.col("local_end").cast(_INT)).over(whole).cast("long").alias("n_local_end"),
        F.last(S.LOSS).over(whole).alias("last_loss"),
    )
    return stage3


def materialize(df: DataFrame, tag: str = "edges") -> DataFrame:
    """Write ``df`` once as a Parquet table under the shared
    ``spark.checkpoint.dir`` and read it back.

    One pass (an eager ``checkpoint()`` computes its input twice: once to
    count, once to write), a lineage cut that survives executor loss, and
    exact size statistics for AQE's join choices downstream.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _chunk_summary(edges: DataFrame) -> DataFrame:
    """One row per (host, chunk): how its first row pairs with the previous
    chunk, and how many starts/ends all earlier chunks of the host hold."""
    # Every chunk's first row carries the chunk totals (see ``edge_frame``).
    per_chunk = edges.where(F.col("is_first")).select(
        S.HOST,
        CHUNK,
        F.col(S.LOSS).alias("first_loss"),
        "last_loss",
        "n_local_start",
        "n_local_end",
        "n_local_lost",
    )
    ws = Window.partitionBy(S.HOST).orderBy(CHUNK)
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    pcl = F.lag("last_loss").over(ws)
    first_start = F.coalesce(F.col("first_loss"), F.lit(False)) & F.coalesce(~pcl, F.lit(True))
    first_end = F.coalesce((F.col("first_loss") == F.lit(False)) & (pcl == F.lit(True)), F.lit(False))
    step = per_chunk.select(
        S.HOST,
        CHUNK,
        "n_local_start",
        "n_local_end",
        "n_local_lost",
        pcl.alias("prev_chunk_last"),
        first_start.alias("first_start"),
        first_end.alias("first_end"),
    )
    n_s = F.col("n_local_start") + F.col("first_start").cast("long")
    n_e = F.col("n_local_end") + F.col("first_end").cast("long")
    return step.select(
        S.HOST,
        CHUNK,
        "prev_chunk_last",
        "first_start",
        "first_end",
        F.coalesce(F.sum(n_s).over(before), F.lit(0)).cast("long").alias("s_off"),
        F.coalesce(F.sum(n_e).over(before), F.lit(0)).cast("long").alias("e_off"),
        F.coalesce(F.sum("n_local_lost").over(before), F.lit(0)).cast("long").alias("lost_off"),
        F.sum("n_local_lost").over(Window.partitionBy(S.HOST)).cast("long").alias("lost_total"),
    )


def _numbered_edges(rows: DataFrame, chunk_unit: str, persist: bool = False) -> DataFrame:
    """Starts and ends in one DataFrame: ``target_host, rn, start_time,
    end_time`` where exactly one of the two times is set, with the host's
    losses before the row (``lost``) and altogether (``lost_total``)."""
    edges = _edge_rows(rows, chunk_unit, persist=persist)
    j = edges.join(_chunk_summary(edges), on=[S.HOST, CHUNK], how="inner")
    is_start = F.col("local_start") | (F.col("is_first") & F.col("first_start"))
    is_end = F.col("local_end") | (F.col("is_first") & F.col("first_end"))
    s_rn = F.col("s_off") + F.col("first_start").cast("long") + F.col("s_ord")
    e_rn = F.col("e_off") + F.col("first_end").cast("long") + F.col("e_ord")
    return j.where(is_start | is_end).select(
        S.HOST,
        F.when(is_start, s_rn).otherwise(e_rn).cast("long").alias("rn"),
        F.when(is_start, F.col(S.TS)).alias("start_time"),
        F.when(is_end, F.col(S.TS)).alias("end_time"),
        (F.col("lost_off") + F.col("lost_before")).alias("lost"),
        "lost_total",
    )


def _paired(rows: DataFrame, chunk_unit: str, persist: bool = False) -> DataFrame:
    """n-th start with n-th end per host: ``target_host, start_time, end_time,
    affected_pings`` (losses from the start up to the end, or to the last row).

    An aggregation on the unique key ``(host, rn)`` (at most one start and
    one end per key) instead of a join of two filtered copies.
    """
    numbered = _numbered_edges(rows, chunk_unit, persist)
    at_start, at_end = F.col("start_time").isNotNull(), F.col("end_time").isNotNull()
    pairs = numbered.groupBy(S.HOST, "rn").agg(
        F.max("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.max(F.when(at_start, F.col("lost"))).alias("lost_at_start"),
        F.coalesce(F.max(F.when(at_end, F.col("lost"))), F.max("lost_total")).alias("lost_at_end"),
    )
    affected = (F.col("lost_at_end") - F.col("lost_at_start")).alias("affected_pings")
    return pairs.where(F.col("start_time").isNotNull()).select(S.HOST, "start_time", "end_time", affected)


def outage_starts(pm: DataFrame, as_of=None, hours=None, host=None, chunk_unit: str = "hour") -> DataFrame:
    """Rows where an outage starts, numbered per host: ``target_host, start_time, rn``."""
    n = _numbered_edges(_window_rows(pm, as_of, hours, host), chunk_unit)
    return n.where(F.col("start_time").isNotNull()).select(S.HOST, "start_time", "rn")


def outage_ends(pm: DataFrame, as_of=None, hours=None, host=None, chunk_unit: str = "hour") -> DataFrame:
    """Rows where an outage ends, numbered per host: ``target_host, end_time, rn``."""
    n = _numbered_edges(_window_rows(pm, as_of, hours, host), chunk_unit)
    return n.where(F.col("end_time").isNotNull()).select(S.HOST, "end_time", "rn")


def downtime_periods(
    pm: DataFrame,
    as_of: datetime | None = None,
    hours: float | None = 24,
    host: str | None = None,
    min_duration_seconds: float = 30,
    include_open: bool = False,
    chunk_unit: str = "hour",
    sort: bool = False,
    materialize: bool = False,
) -> DataFrame:
    """Outages of every host (or one): ``target_host, start_time, end_time, duration_seconds``.

    ``hours=None`` analyses the full history. With ``include_open`` an outage
    still running at the end of the data is kept with ``end_time`` NULL and
    its duration measured up to ``as_of``. The plan is lazy and the same for
    every input size; ``materialize=True`` writes the edge set to the shared
    checkpoint folder first, for callers who use the result several times.
    """
    out = _outages(pm, as_of, hours, host, min_duration_seconds, include_open, chunk_unit, materialize)
    out = out.select(S.HOST, "start_time", "end_time", "duration_seconds")
    if sort:  # API order: newest start first
        out = out.orderBy(F.desc("start_time"), F.asc(S.HOST))
    return out


def _outages(pm, as_of, hours, host, min_duration_seconds, include_open, chunk_unit, materialize=False) -> DataFrame:
    if min_duration_seconds < 0:
        raise ValueError("min_duration_seconds must be >= 0")
    j = _paired(_window_rows(pm, as_of, hours, host), chunk_unit, materialize)
    if not include_open:
        j = j.where(F.col("end_time").isNotNull())
    dur = epoch_seconds("start_time", "end_time")
    if include_open:
        if as_of is None:
            raise ValueError("include_open needs as_of to measure open outages")
        dur = F.coalesce(dur, epoch_seconds(F.col("start_time"), ts_literal(as_of)))
    out = j.select(S.HOST, "start_time", "end_time", dur.alias("duration_seconds"), "affected_pings")
    return out.where(F.col("duration_seconds") >= F.lit(float(min_duration_seconds)))


def downtime_pair_join(pm: DataFrame, as_of=None, hours=24, host=None, min_duration_seconds=30, chunk_unit="hour"):
    """The literal pairing form: starts LEFT JOIN ends on ``(host, rn)``, then
    ``end_time IS NOT NULL`` (an inner join after Catalyst). Both sides read
    the same edge set through one exchange."""
    n = _numbered_edges(_window_rows(pm, as_of, hours, host), chunk_unit)
    starts = n.where(F.col("start_time").isNotNull()).select(S.HOST, "rn", "start_time")
    ends = n.where(F.col("end_time").isNotNull()).select(S.HOST, "rn", "end_time")
    j = starts.join(ends, on=[S.HOST, "rn"], how="left").where(F.col("end_time").isNotNull())
    dur = epoch_seconds("start_time", "end_time")
    return j.select(S.HOST, "start_time", "end_time", dur.alias("duration_seconds")).where(
        F.col("duration_seconds") >= F.lit(float(min_duration_seconds))
    )


def downtime_next_edge(
    pm: DataFrame,
    as_of: datetime | None = None,
    hours: float | None = 24,
    host: str | None = None,
    min_duration_seconds: float = 30,
    chunk_unit: str = "hour",
) -> DataFrame:
    """Second formulation for non-NULL flags: each start ends at the next edge.

    Within a chunk the next edge comes from ``lead`` over the edge rows; a
    chunk's last start takes the first edge of the host's next chunk that has
    one (from the per-chunk summary). Equal to ``downtime_periods`` whenever
    ``packet_loss`` has no NULLs (normalised input).
    """
    rows = _window_rows(pm, as_of, hours, host)
    edges = _edge_rows(rows, chunk_unit)
    summ = _chunk_summary(edges)
    j = edges.join(summ, on=[S.HOST, CHUNK], how="inner")
    is_start = F.col("local_start") | (F.col("is_first") & F.col("first_start"))
    is_end = F.col("local_end") | (F.col("is_first") & F.col("first_end"))
    e = j.where(is_start | is_end).select(S.HOST, CHUNK, S.TS, S.ID, is_start.alias("is_start"))
    w = Window.partitionBy(S.HOST, CHUNK).orderBy(S.TS, S.ID)
    e = e.select("*", F.lead(S.TS).over(w).alias("next_ts"))
    # First edge time of each chunk, then of the next chunk that has edges.
    firsts = e.groupBy(S.HOST, CHUNK).agg(F.min(S.TS).alias("first_edge_ts"))
    wc = Window.partitionBy(S.HOST).orderBy(CHUNK)
    nxt = firsts.select(S.HOST, CHUNK, F.lead("first_edge_ts").over(wc).alias("next_chunk_edge"))
    out = (
        e.where(F.col("is_start"))
        .join(nxt, on=[S.HOST, CHUNK], how="inner")
        .select(
            S.HOST,
            F.col(S.TS).alias("start_time"),
            F.coalesce("next_ts", "next_chunk_edge").alias("end_time"),
        )
        .where(F.col("end_time").isNotNull())
    )
    return out.select("*", epoch_seconds("start_time", "end_time").alias("duration_seconds")).where(
        F.col("duration_seconds") >= F.lit(float(min_duration_seconds))
    )


def event_ordinal(dt: DataFrame) -> DataFrame:
    """"Event n" numbering per host, newest outage first (``event_no`` bigint).

    Ordinals are computed like the outage ordinals: counts per (host, day)
    plus a local rank, so no host's outage list is ranked in a single task.
    """
    day = bucket("start_time", "day").alias("_day")
    d = dt.select("*", day)
    wl = Window.partitionBy(S.HOST, "_day").orderBy(F.desc("start_time"), F.desc("end_time"))
    local = d.select("*", F.row_number().over(wl).cast("long").alias("_local"))
    counts = d.groupBy(S.HOST, "_day").agg(F.count(F.lit(1)).alias("_n"))
    wd = Window.partitionBy(S.HOST).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(S.HOST, "_day", F.coalesce(F.sum("_n").over(wd), F.lit(0)).cast("long").alias("_off"))
    return local.join(offs, on=[S.HOST, "_day"], how="inner").select(
        *[c for c in dt.columns], (F.col("_off") + F.col("_local")).alias("event_no")
    )


def downtime_report(dt: DataFrame, hours_analyzed: float | None = 24, min_duration_seconds: float = 30) -> DataFrame:
    """Outage report: per host and start day, the periods (newest first) plus
    scalar fields; ``total_downtime_events`` counts the host's whole list.

    Periods are grouped per (host, day) so no array grows with the history.
    Columns: ``host, period_date, hours_analyzed, min_duration_seconds,
    downtime_periods array<struct<start_time,end_time,duration_seconds>>,
    events_in_period, total_downtime_events``.
    """
    day = F.to_date("start_time").alias("period_date")
    per_day = dt.groupBy(S.HOST, day).agg(
        F.sort_array(
            F.collect_list(F.struct("start_time", "end_time", "duration_seconds")), asc=False
        ).alias("downtime_periods"),
        F.count(F.lit(1)).alias("events_in_period"),
    )
    wh = Window.partitionBy(S.HOST)
    return per_day.select(
        F.col(S.HOST).alias("host"),
        "period_date",
        F.lit(hours_analyzed).cast("double").alias("hours_analyzed"),
        F.lit(float(min_duration_seconds)).alias("min_duration_seconds"),
        "downtime_periods",
        "events_in_period",
        F.sum("events_in_period").over(wh).cast("long").alias("total_downtime_events"),
    )


def downtime_totals(dt: DataFrame, hours_analyzed: float | None = None) -> DataFrame:
    """Per host: events, total minutes and mean seconds (1 decimal each).

    Mean is NULL for a host without events (the dashboard shows NaN there).
    """
    return dt.groupBy(S.HOST).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.round(F.sum("duration_seconds") / F.lit(60.0), 1).alias("total_downtime_minutes"),
        F.round(F.avg("duration_seconds"), 1).alias("avg_duration_seconds"),
        F.lit(hours_analyzed).cast("double").alias("hours_analyzed"),
    )


def downtime_by_hour(dt: DataFrame, gap_fill: bool = False, per_host: bool = True) -> DataFrame:
    """Outage seconds and counts booked to the hour in which each outage starts.

    Columns: ``[target_host,] hour_bucket, hour, time_label, total_downtime,
    events, downtime_label``. Empty hours are absent unless ``gap_fill``;
    gap filling generates the hour sequence per host from its first to last
    bucket and left-joins the counts.
    """
    keys = [S.HOST] if per_host else []
    hb = bucket("start_time", "hour").alias("hour_bucket")
    agg = dt.groupBy(*keys, hb).agg(
        F.sum("duration_seconds").alias("total_downtime"),
        F.count(F.lit(1)).alias("events"),
    )
    if gap_fill:
        bounds = agg.groupBy(*keys).agg(F.min("hour_bucket").alias("_lo"), F.max("hour_bucket").alias("_hi"))
        hours = bounds.select(
            *keys,
            F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 HOUR"))).alias("hour_bucket"),
        )
        agg = hours.join(agg, on=keys + ["hour_bucket"], how="left").select(
            *keys,
            "hour_bucket",
            F.coalesce("total_downtime", F.lit(0.0)).alias("total_downtime"),
            F.coalesce("events", F.lit(0)).cast("long").alias("events"),
        )
    return agg.select(
        *keys,
        "hour_bucket",
        F.hour("hour_bucket").cast("long").alias("hour"),
        F.date_format("hour_bucket", "MMM d, HH:mm").alias("time_label"),
        "total_downtime",
        "events",
        F.format_string("%.1fm", F.col("total_downtime") / F.lit(60.0)).alias("downtime_label"),
    )


def affected_pings(
    pm: DataFrame,
    as_of: datetime | None = None,
    hours: float | None = 24,
    host: str | None = None,
    min_duration_seconds: float = 30,
    include_open: bool = False,
    chunk_unit: str = "hour",
) -> DataFrame:
    """The outages of ``downtime_periods`` with ``affected_pings``: the lost probes
    from the start up to the end, or up to the last row for an open outage.

    Counted along the way: losses before the end row minus losses before the
    start row, in the host's row order. No join with the probes.
    """
    return _outages(pm, as_of, hours, host, min_duration_seconds, include_open, chunk_unit)


def downtime_alerts(dt: DataFrame, min_hours: float) -> DataFrame:
    """Outages lasting at least ``min_hours`` hours (alert feed)."""
    return dt.where(F.col("duration_seconds") >= F.lit(float(min_hours) * 3600.0))
