"""Hourly partial aggregates, kept as a table and refreshed where the facts changed.

A row of the rollup holds what merges: probes, answered probes, the sum of their
times, losses, least and greatest time of one host and hour. Days, weeks and any
longer trend follow from it without the facts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwatch import schema as S
from linkwatch.functions.timefns import bucket
from linkwatch.operators.filters import host_filter, lost
from linkwatch.sources.table import MetricTable
from linkwatch.sources.versions import VersionedTable

HOUR = "hour_bucket"
ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField(HOUR, T.TimestampNTZType(), False),
        T.StructField(S.HOST, T.StringType(), True),
        T.StructField("probes", T.LongType(), False),
        T.StructField("answered", T.LongType(), False),
        T.StructField("time_sum", T.DoubleType(), True),
        T.StructField("losses", T.LongType(), False),
        T.StructField("least", T.DoubleType(), True),
        T.StructField("greatest", T.DoubleType(), True),
    ]
)


def hourly_partials(pm: DataFrame) -> DataFrame:
    """The rollup rows of fact rows."""
    return pm.groupBy(bucket(S.TS, "hour").alias(HOUR), S.HOST).agg(
        F.count(F.lit(1)).alias("probes"),
        F.count(S.RT).alias("answered"),
        F.sum(S.RT).alias("time_sum"),
        F.count_if(lost()).alias("losses"),
        F.min(S.RT).alias("least"),
        F.max(S.RT).alias("greatest"),
    )


def merged(partials: DataFrame, by: Column) -> DataFrame:
    """Partials put together by host and ``by`` (named as the hour)."""
    sums = [F.sum(c).alias(c) for c in ("probes", "answered", "time_sum", "losses")]
    return partials.groupBy(by.alias(HOUR), S.HOST).agg(*sums, F.min("least").alias("least"), F.max("greatest").alias("greatest"))


class Rollup(VersionedTable):
    """The rollup of a ``MetricTable``; its log says which version of the facts it holds."""

    def __init__(self, spark: SparkSession, path: str, facts: MetricTable) -> None:
        super().__init__(spark, path, ROLLUP_SCHEMA, HOUR)
        self.facts = facts

    def layout(self, rows: DataFrame, files: int | None) -> DataFrame:
        rows = rows.hint("rebalance", self.day) if files is None else rows.repartitionByRange(files, self.day, HOUR)
        return rows.sortWithinPartitions(self.day, S.HOST, HOUR)

    def refresh(self) -> int:
        """Bring the rollup to the facts' newest version; the number of dates written.

        Rows added since are aggregated alone and merged with the rollup of their
        dates. Dates that lost rows (retention) are aggregated anew, or leave. What
        compaction has only rewritten changes nothing.
        """
        was = self.state().done.get("facts", -1)
        now = self.facts.state()
        if now.version == was:
            return 0
        grown, shrunk, fresh = set(), set(), {}
        for entry in self.facts.entries(was, now.version):
            if entry.get("operation") == "compact":
                continue
            removed = [day for _, day in entry.get("remove", [])]
            shrunk.update(removed)
            for f in entry.get("add", []):
                if f["day"] not in removed:
                    grown.add(f["day"])
                    fresh[f["name"], f["day"]] = f
        # New folders that compaction has replaced meanwhile: their dates are aggregated anew.
        there = {k for k in fresh if k in now.folders}
        anew = shrunk | {day for name, day in fresh if (name, day) not in there}
        added = [now.folders[k] for k in there if k[1] not in anew]
        live = [f for f in now.folders.values() if f.day in anew]
        mine = list(self.state().folders.values())
        old = [f for f in mine if f.day in anew | grown]
        parts = [hourly_partials(self.facts.read(live))] if live else []
        kept = [f for f in old if f.day not in anew]
        if added:
            parts.append(hourly_partials(self.facts.read(added)))
        if kept:
            parts.append(self.read(kept).drop(self.day))
        rows = None
        for p in parts:
            rows = p if rows is None else rows.unionByName(p)
        rows = merged(rows, F.col(HOUR)) if rows is not None else None
        # Of two that refresh at once, one writes.
        self.replace(old, rows, "refresh", extra={"done": {"facts": now.version}}, unless=lambda s: s.done.get("facts", -1) != was)
        return len(anew | grown)


def trend(rollup: DataFrame, unit: str = "day", host: str | None = None, since: datetime | None = None) -> DataFrame:
    """Statistics per (bucket, host) for ``unit`` hour, day, week or month, from hourly partials.

    ``hour_bucket, target_host, avg_response_time, packet_count, packet_loss_rate``
    (percent) as ``hourly_stats`` gives them, and ``min_response_time``,
    ``max_response_time``.
    """
    rows = host_filter(rollup, host)
    if since is not None:
        rows = rows.where(F.col(HOUR) >= F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz"))
    rows = merged(rows, bucket(HOUR, unit))
    return rows.select(
        HOUR,
        S.HOST,
        F.try_divide("time_sum", F.col("answered").cast("double")).alias("avg_response_time"),
        F.col("probes").alias("packet_count"),
        (F.try_divide(F.col("losses").cast("double"), F.col("probes").cast("double")) * F.lit(100.0)).alias("packet_loss_rate"),
        F.col("least").alias("min_response_time"),
        F.col("greatest").alias("max_response_time"),
    )
