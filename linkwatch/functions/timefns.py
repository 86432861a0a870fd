"""Time expressions shared by the operators (all JVM-side column expressions)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("second", "minute", "hour", "day", "week", "month")


_UNIT_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
_EPOCH = "1970-01-01 00:00:00"


def bucket(ts: Column | str, unit: str = "hour") -> Column:
    """Truncate a TIMESTAMP_NTZ to ``unit``; the result stays TIMESTAMP_NTZ.

    Pure wall-clock arithmetic (microseconds since the epoch modulo the unit,
    or ``trunc`` on the date for week/month), so the session time zone
    never enters; equal to ``date_trunc`` in a UTC session.
    """
    if unit not in _UNITS:
        raise ValueError(f"unit must be one of {_UNITS}, got {unit!r}")
    c = F.col(ts) if isinstance(ts, str) else ts
    if unit in _UNIT_US:
        us = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), c)
        return F.timestamp_add("MICROSECOND", -F.pmod(us, F.lit(_UNIT_US[unit])), c)
    return F.trunc(F.to_date(c), unit).cast("timestamp_ntz")


def epoch_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds between two timestamps as DOUBLE (microsecond exact)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", s, e).cast("double") / F.lit(1e6)


def window_start(as_of: datetime, hours: float | None = None, minutes: float | None = None) -> datetime | None:
    """Lower bound of a look-back window, computed on the driver.

    ``minutes`` wins over ``hours``; both falsy means "no bound".
    """
    if minutes:
        return as_of - timedelta(minutes=minutes)
    if hours:
        return as_of - timedelta(hours=hours)
    return None


def ts_literal(value: datetime) -> Column:
    """A TIMESTAMP_NTZ literal (the fact table stores NTZ in batch).

    Built from ISO text so neither the Python process's nor the session's
    time zone can shift the wall-clock value.
    """
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def iso_text(ts: Column | str) -> Column:
    """ISO-8601 text with microseconds, as the prober writes timestamps."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def utc_now() -> Column:
    """Current time as a UTC wall-clock TIMESTAMP_NTZ, whatever the session zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


def whole_hours(minutes: Column | str) -> Column:
    """Minutes as hours, rounded up (a 90-minute range asks for 2 hours)."""
    c = F.col(minutes) if isinstance(minutes, str) else minutes
    return F.ceil(c / F.lit(60)).cast("long")
