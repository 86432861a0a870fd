"""Registered streaming queries.

Each reads the given ``events`` table as a file stream, runs with
``availableNow`` into sinks under the shared checkpoint folder and returns what
the sinks hold.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwatch import schema as S
from linkwatch.plans.catalog import register, with_pm
from linkwatch.plans.queries_core import PM_COLS, _DNS_IN, _LATEST_SQL, _r6, downtime_sql
from linkwatch.operators import downtime as D
from linkwatch.operators import filters as P
from linkwatch.operators import latest as L
from linkwatch.session import scratch_path
from linkwatch.sources.ingest import raw_probes_from_metrics
from linkwatch.sources.metrics import EVENTS_SCHEMA, append_metrics, load_events, load_pm, pm_from_events, scan_metrics
from linkwatch.streaming import jobs as J
from linkwatch.streaming import outages as O

def _run_dir(spark: SparkSession, tag: str) -> str:
    return scratch_path(spark, f"stream-{tag}-{uuid.uuid4().hex[:12]}")


def _metric_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact rows of the given table as a stream, with TIMESTAMP times."""
    return J.to_event_time(pm_from_events(_event_stream(spark, sf_dir)))


#: Micro-batches in which the registered streams read the table.
PARTS = 4


def _event_stream(spark: SparkSession, sf_dir: str, parts: int = PARTS, more: DataFrame | None = None) -> DataFrame:
    """The given ``events`` table as a file stream of ``parts`` micro-batches, in the order of time.

    The rows of each quarter of the time are written one after the other, in as
    many files each as a micro-batch takes. ``more`` comes with the last one.
    """
    events = load_events(spark, sf_dir)
    path = _run_dir(spark, "events")
    shares = [k / parts for k in range(1, parts)]
    bounds = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), shares)).first()[0] or []  # parts - 1 numbers
    files = max(1, -(-events.rdd.getNumPartitions() // parts))
    quarter = F.lit(0)
    for b in bounds:
        quarter = quarter + (F.unix_micros(F.col("ts").cast("timestamp")) > F.lit(b)).cast("int")
    for i in range(parts):
        rows = events.where(quarter == i)
        rows = rows.unionByName(more) if more is not None and i == parts - 1 else rows
        rows.repartition(files).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files).parquet(path).drop("part")


def _ntz(df: DataFrame) -> DataFrame:
    from pyspark.sql import types as T

    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


@register("stream_latest", _LATEST_SQL)
def q_stream_latest(spark, sf_dir):
    """Latest-per-host state after streaming the whole table (complete mode)."""
    base = _run_dir(spark, "latest")
    src = _metric_stream(spark, sf_dir)
    J.run_available_now(J.stream_latest(src), f"{base}/out", f"{base}/ckpt", mode="complete")
    return _ntz(J.read_versions(spark, f"{base}/out"))


@register(
    "stream_downtime",
    downtime_sql() + "\nSELECT * FROM dt",
)
def q_stream_downtime(spark, sf_dir):
    """Outages from the stream, in event-time order behind the watermark."""
    return J.downtime_of_feed(_metric_stream(spark, sf_dir), _run_dir(spark, "downtime"), 30).outages()


@register(
    "stream_downtime_processor",
    downtime_sql() + "\nSELECT * FROM dt",
)
def q_stream_downtime_processor(spark, sf_dir):
    """Outages from the stream by keyed state of (host, hour) and host (RocksDB); a closing row ends the feed."""
    base = _run_dir(spark, "downtime-tws")
    end = load_events(spark, sf_dir).agg(F.max("ts") + F.expr("INTERVAL 3 HOURS")).first()[0]  # one value
    last = spark.createDataFrame([(0, end, None, "view", None, None)] if end else [], EVENTS_SCHEMA)
    src = J.to_event_time(pm_from_events(_event_stream(spark, sf_dir, more=last)))
    with _rocksdb(spark):
        J.run_available_now(O.stream_outages(src, 30), f"{base}/out", f"{base}/ckpt")
    return _ntz(spark.read.schema(J.DOWNTIME_OUT_SCHEMA).parquet(f"{base}/out"))


@contextmanager
def _rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, J.ROCKSDB_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@register(
    "stream_downtime_alerts",
    downtime_sql(min_duration=360) + "\nSELECT * FROM dt",
)
def q_stream_downtime_alerts(spark, sf_dir):
    """Alert feed from the stream: outages of at least 0.1 h."""
    return J.downtime_of_feed(_metric_stream(spark, sf_dir), _run_dir(spark, "alerts"), 360).outages()


_LATE = "1 hour"


@register(
    "stream_hourly_stats",
    with_pm(
        """
SELECT date_trunc('hour', "timestamp") AS hour_bucket, target_host,
       round(AVG(response_time_ms), 6) AS avg_response_time,
       COUNT(*) AS packet_count,
       round(CAST(COUNT(*) FILTER (WHERE packet_loss = TRUE) AS DOUBLE) / COUNT(*) * 100, 6) AS packet_loss_rate
FROM pm
GROUP BY 1, 2"""
    ),
)
def q_stream_hourly_stats(spark, sf_dir):
    """Hourly statistics from the stream, windows still open at the end too."""
    base = _run_dir(spark, "hourly")
    src = _metric_stream(spark, sf_dir)
    J.run_available_now(J.stream_hourly_stats(src, lateness=_LATE), f"{base}/out", f"{base}/ckpt", mode="update")
    out = J.read_versions(spark, f"{base}/out", ("hour_bucket", S.HOST))
    return _r6(_ntz(out), "avg_response_time", "packet_loss_rate")


@register(
    "stream_cycle_success",
    with_pm(
        """
SELECT time_bucket(INTERVAL 10 SECOND, "timestamp") AS cycle_start,
       time_bucket(INTERVAL 10 SECOND, "timestamp") + INTERVAL 10 SECOND AS cycle_end,
       COUNT(*) FILTER (WHERE packet_loss = FALSE) AS successful_pings, COUNT(*) AS total_pings
FROM pm
GROUP BY 1, 2"""
    ),
)
def q_stream_cycle_success(spark, sf_dir):
    """Per-cycle success counts from the stream, windows still open at the end too."""
    base = _run_dir(spark, "cycles")
    src = _metric_stream(spark, sf_dir)
    J.run_available_now(J.stream_cycle_success(src, "10 seconds", lateness="1 minute"), f"{base}/out", f"{base}/ckpt", mode="update")
    return _ntz(J.read_versions(spark, f"{base}/out", ("cycle_start",)))


_INGESTED = f"""
SELECT target_host, CASE WHEN response_time_ms IS NULL THEN NULL ELSE round(response_time_ms, 2) END AS response_time_ms,
       response_time_ms IS NULL AS packet_loss,
       CASE WHEN response_time_ms IS NULL THEN '{S.LOSS_MESSAGE}' END AS error_message,
       "timestamp", CAST("timestamp" AS DATE) AS metric_date
FROM pm"""


def _raw_stream(spark, sf_dir):
    return raw_probes_from_metrics(pm_from_events(_event_stream(spark, sf_dir))).drop("probe_id")


@register("stream_ingest", with_pm(_INGESTED))
def q_stream_ingest(spark, sf_dir):
    """Raw probe results (text times) streamed into the date-partitioned fact
    table; ids (hashes) and ``created_at`` (processing time) are left out of the check."""
    base = _run_dir(spark, "ingest")
    J.stream_ingest(_raw_stream(spark, sf_dir), f"{base}/table", f"{base}/ckpt", {"availableNow": True}).awaitTermination()
    return scan_metrics(spark, f"{base}/table").drop(S.CREATED, S.ID)


def _mixed_table(spark, sf_dir):
    """A table with the rows of even ids from the stream and those of odd ids from a batch write."""
    base = _run_dir(spark, "mixed")
    even = _event_stream(spark, sf_dir).where("event_id % 2 = 0")
    raw = raw_probes_from_metrics(pm_from_events(even)).withColumnRenamed("probe_id", S.ID)
    J.stream_ingest(raw, f"{base}/table", f"{base}/ckpt", {"availableNow": True}).awaitTermination()
    append_metrics(load_pm(spark, sf_dir).where(F.col(S.ID) % 2 == 1), f"{base}/table")
    return scan_metrics(spark, f"{base}/table").drop(S.METRIC_DATE)


@register("mixed_writers_downtime", downtime_sql() + "\nSELECT * FROM dt")
def q_mixed_writers_downtime(spark, sf_dir):
    """Outages of a table that a stream and a batch writer have filled."""
    return D.downtime_periods(_mixed_table(spark, sf_dir), hours=None, min_duration_seconds=30)


@register("mixed_writers_latest", with_pm('SELECT target_host, id, "timestamp" FROM (SELECT *, row_number() OVER (PARTITION BY target_host ORDER BY "timestamp" DESC, id DESC) AS rn FROM pm) WHERE rn = 1'))
def q_mixed_writers_latest(spark, sf_dir):
    """Latest row of each host of a table that a stream and a batch writer have filled."""
    return L.latest_per_host(_mixed_table(spark, sf_dir)).select(S.HOST, S.ID, S.TS)


@register("mixed_writers_by_id", with_pm('SELECT target_host, "timestamp", packet_loss FROM pm WHERE id = 42'))
def q_mixed_writers_by_id(spark, sf_dir):
    """A row that the stream wrote, by its id."""
    return P.metric_by_id(_mixed_table(spark, sf_dir), 42).select(S.HOST, S.TS, S.LOSS)


@register(
    "stream_dns_route",
    with_pm(
        f"""
SELECT 'dns feed' AS feed, {PM_COLS}, 'dns' AS route, '{S.MSG_DNS_UPDATE}' AS message_type FROM pm WHERE target_host IN ({_DNS_IN})
UNION ALL
SELECT 'full feed', {PM_COLS}, CASE WHEN target_host IN ({_DNS_IN}) THEN 'dns' ELSE 'all' END,
       CASE WHEN target_host IN ({_DNS_IN}) THEN '{S.MSG_DNS_UPDATE}' ELSE '{S.MSG_PING_UPDATE}' END FROM pm"""
    ),
)
def q_stream_dns_route(spark, sf_dir):
    """Both feeds of the routed stream."""
    base = _run_dir(spark, "route")
    src = _metric_stream(spark, sf_dir)
    dns, full = J.start_feeds(J.stream_dns_route(src), f"{base}/dns", f"{base}/all", f"{base}/ckpt", {"availableNow": True})
    dns.awaitTermination()
    full.awaitTermination()
    feed = lambda name, path: _ntz(spark.read.parquet(path)).withColumn("feed", F.lit(name))
    return feed("dns feed", f"{base}/dns").unionByName(feed("full feed", f"{base}/all"))


@register(
    "stream_host_filter",
    with_pm(f"SELECT {PM_COLS} FROM pm WHERE target_host IN ('google.com', '1.1.1.1')"),
)
def q_stream_host_filter(spark, sf_dir):
    """Rows of subscribed hosts (stream-static semi join)."""
    base = _run_dir(spark, "subs")
    src = _metric_stream(spark, sf_dir)
    J.run_available_now(J.stream_host_filter(src, ["google.com", "1.1.1.1"]), f"{base}/out", f"{base}/ckpt")
    return _ntz(spark.read.parquet(f"{base}/out"))


@register(
    "stream_ingest_json",
    with_pm("SELECT target_host, response_time_ms, COALESCE(packet_loss, FALSE) AS packet_loss, error_message FROM pm"),
)
def q_stream_ingest_json(spark, sf_dir):
    """Every fact row as a JSON insert request (text lines), streamed into
    the fact table; the ingest-time columns are left out of the check."""
    base = _run_dir(spark, "ingest-json")
    pm = load_pm(spark, sf_dir)
    pm.select(F.to_json(F.struct(S.HOST, S.RT, S.LOSS, S.ERR)).alias("value")).write.text(f"{base}/in")
    q_rows, q_rej = J.stream_ingest_json(
        spark, f"{base}/in", f"{base}/table", f"{base}/rejects", f"{base}/ckpt", {"availableNow": True}
    )
    q_rows.awaitTermination()
    q_rej.awaitTermination()
    return scan_metrics(spark, f"{base}/table").select(S.HOST, S.RT, S.LOSS, S.ERR)
