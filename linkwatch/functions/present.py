"""Display helpers: number labels, reliability tiers, time labels.

Labels use ``format_string``; its rounding is half-up on the decimal value
(1.005 -> "1.01"), where a browser's ``toFixed`` rounds the binary value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwatch import schema as S


def fixed(col: Column | str, decimals: int, suffix: str = "") -> Column:
    """``x.toFixed(decimals) + suffix``; NULL stays NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.format_string(f"%.{int(decimals)}f" + suffix.replace("%", "%%"), c)


def or_placeholder(col: Column | str, placeholder: str = "--") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(placeholder))


def reliability_status(uptime: Column | str) -> Column:
    """Tier name for an uptime percent: Excellent / Good / Fair / Poor."""
    u = F.col(uptime) if isinstance(uptime, str) else uptime
    expr = None
    for lo, status, _ in S.RELIABILITY_TIERS:
        expr = F.when(u >= F.lit(lo), F.lit(status)) if expr is None else expr.when(u >= F.lit(lo), F.lit(status))
    return expr.otherwise(F.lit(S.RELIABILITY_FLOOR[0]))


def reliability_tier(uptime: Column | str) -> Column:
    """Colour tier for an uptime percent: primary / secondary / muted."""
    u = F.col(uptime) if isinstance(uptime, str) else uptime
    expr = None
    for lo, _, tier in S.RELIABILITY_TIERS:
        expr = F.when(u >= F.lit(lo), F.lit(tier)) if expr is None else expr.when(u >= F.lit(lo), F.lit(tier))
    return expr.otherwise(F.lit(S.RELIABILITY_FLOOR[1]))


def with_reliability(summary: DataFrame, uptime_col: str = "uptime_percentage") -> DataFrame:
    """Adds ``status`` and ``tier`` columns to a summary."""
    return summary.select("*", reliability_status(uptime_col).alias("status"), reliability_tier(uptime_col).alias("tier"))


def format_metrics(summary: DataFrame) -> DataFrame:
    """Dashboard labels for a host summary.

    uptime 1 decimal + %, averages 1 and 2 decimals + ms, median/min/max/p95
    2 decimals + ms, loss rate as percent 2 decimals + %, counts 0 decimals.
    """
    return summary.select(
        "host",
        fixed("uptime_percentage", 1, "%").alias("uptime_label"),
        fixed("avg_response_time", 1, "ms").alias("avg_label"),
        fixed("avg_response_time", 2, "ms").alias("avg_detail_label"),
        fixed("median_response_time", 2, "ms").alias("median_label"),
        fixed("min_response_time", 2, "ms").alias("min_label"),
        fixed("max_response_time", 2, "ms").alias("max_label"),
        fixed("p95_response_time", 2, "ms").alias("p95_label"),
        fixed(F.col("packet_loss_rate") * F.lit(100.0), 2, "%").alias("loss_rate_label"),
        fixed(F.col("total_pings").cast("double"), 0).alias("total_label"),
        fixed(F.col("packet_losses").cast("double"), 0).alias("losses_label"),
    )


def location_label(city: Column | str, country: Column | str) -> Column:
    """"City, Country" when both are known, else "--"."""
    ci = F.col(city) if isinstance(city, str) else city
    co = F.col(country) if isinstance(country, str) else country
    return F.when(ci.isNotNull() & co.isNotNull() & (ci != F.lit("")) & (co != F.lit("")), F.concat_ws(", ", ci, co)).otherwise(
        F.lit("--")
    )


def clock_label(ts: Column | str) -> Column:
    """24-hour ``HH:mm:ss`` (midnight prints 00)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "HH:mm:ss")


def bucket_label(ts: Column | str) -> Column:
    """Short month, day and 24-hour time, e.g. ``Jan 5, 09:00``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "MMM d, HH:mm")


def time_labels(pm: DataFrame) -> DataFrame:
    """Per row: ``time`` (HH:mm:ss), ``bucket_label`` of its hour, ``hour`` (bigint)."""
    from linkwatch.functions.timefns import bucket

    return pm.select(
        S.ID,
        S.TS,
        clock_label(S.TS).alias("time"),
        bucket_label(bucket(S.TS, "hour")).alias("bucket_label"),
        F.hour(S.TS).cast("long").alias("hour"),
    )


def host_input(col: Column | str) -> Column:
    """Host typed by a user: trimmed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c)


def url_component(col: Column | str) -> Column:
    """``encodeURIComponent``-style escaping (space as %20, not +)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
