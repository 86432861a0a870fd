"""Registered queries on the versioned table, what is kept of it, and streams into it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwatch import schema as S
from linkwatch.operators import downtime as D
from linkwatch.operators import latest as L
from linkwatch.operators import rollup as R
from linkwatch.plans.catalog import AS_OF_SQL, register, with_pm
from linkwatch.plans.queries_core import _DNS_IN, _LATEST_SQL, _ROUTED_SQL, PM_COLS, _MESSAGE, _laid_out, downtime_sql
from linkwatch.plans.queries_stream import _metric_stream, _ntz, _run_dir
from linkwatch.sources.keyed import KeyedStore, latest_store, put_latest
from linkwatch.sources.metrics import load_events, load_pm
from linkwatch.sources.table import MetricTable, stream_into
from linkwatch.streaming import cycles as C
from linkwatch.streaming import jobs as J
from linkwatch.streaming import subscriptions as U

AS_OF = S.FIXTURE_AS_OF


def _stored(spark: SparkSession, sf_dir: str, writes: int = 3) -> MetricTable:
    """The fact table written as several versions, the rows of a version all over its time."""
    table = MetricTable(spark, f"{_run_dir(spark, 'table')}/facts")
    pm = load_pm(spark, sf_dir)
    for i in range(writes):
        table.append(pm.where(F.pmod(F.col(S.ID), F.lit(writes)) == i), "load", i)
    return table


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*S.METRIC_COLUMNS)


@register("table_compacted", with_pm(f"SELECT {PM_COLS} FROM pm"))
def q_table_compacted(spark, sf_dir):
    """The rows of a table after its small folders were rewritten along the curve."""
    table = _stored(spark, sf_dir)
    table.compact()
    return _plain(table.scan())


@register("table_retained", with_pm(f"SELECT {PM_COLS} FROM pm WHERE \"timestamp\" >= {AS_OF_SQL} - INTERVAL 10 DAY"))
def q_table_retained(spark, sf_dir):
    """The rows of a table after those of more than ten days ago were deleted as one version."""
    table = _stored(spark, sf_dir, 2)
    table.compact()
    table.retain(AS_OF - timedelta(days=10))
    return _plain(table.scan())


@register("table_as_of_version", with_pm(f"SELECT {PM_COLS} FROM pm WHERE id % 3 < 2"))
def q_table_as_of_version(spark, sf_dir):
    """The rows of the version that a reader holds while others add, compact and delete."""
    table = MetricTable(spark, f"{_run_dir(spark, 'table')}/facts")
    pm = load_pm(spark, sf_dir)
    for i in range(2):
        table.append(pm.where(F.pmod(F.col(S.ID), F.lit(3)) == i), "load", i)
    version = table.state().version
    table.append(pm.where(F.pmod(F.col(S.ID), F.lit(3)) == 2), "load", 2)
    table.compact()
    table.retain(AS_OF - timedelta(days=5))
    return _plain(table.scan(version=version))


@register(
    "table_lookup",
    with_pm(f"SELECT {PM_COLS} FROM pm WHERE id = (SELECT max(event_id) // 2 FROM events)"),
)
def q_table_lookup(spark, sf_dir):
    """A row by its id, from files whose bloom filters may hold it."""
    wanted = load_events(spark, sf_dir).agg(F.floor(F.max("event_id") / 2)).first()[0]  # one value
    table = _stored(spark, sf_dir)
    table.compact()
    return table.by_id(wanted or 0)


@register(
    "table_stream_ids",
    with_pm("""
SELECT count(*) + (SELECT count(*) FROM pm WHERE id % 2 = 1) AS n, 1::BIGINT AS first_id, count(*) + (SELECT count(*) FROM pm WHERE id % 2 = 1) AS last_id,
       count(*) + (SELECT count(*) FROM pm WHERE id % 2 = 1) AS distinct_ids FROM pm"""),
)
def q_table_stream_ids(spark, sf_dir):
    """Ids of a table that a stream in four micro-batches and a batch writer have filled: consecutive, each once."""
    base = _run_dir(spark, "ids")
    table = MetricTable(spark, f"{base}/facts")
    table.append(load_pm(spark, sf_dir).where(F.pmod(F.col(S.ID), F.lit(2)) == 1).drop(S.ID))
    rows = _ntz(_metric_stream(spark, sf_dir)).drop(S.ID)
    stream_into(rows, table, f"{base}/ckpt", {"availableNow": True}, compact_every=2).awaitTermination()
    return table.scan().agg(F.count("*").alias("n"), F.min(S.ID).alias("first_id"), F.max(S.ID).alias("last_id"), F.count_distinct(S.ID).alias("distinct_ids"))


@register("table_stream_downtime", downtime_sql() + "\nSELECT * FROM dt")
def q_table_stream_downtime(spark, sf_dir):
    """Outages of the table that a stream has filled and compacted."""
    base = _run_dir(spark, "facts")
    table = MetricTable(spark, f"{base}/facts")
    stream_into(_ntz(_metric_stream(spark, sf_dir)), table, f"{base}/ckpt", {"availableNow": True}, compact_every=3).awaitTermination()
    return D.downtime_periods(table.scan(), hours=None, min_duration_seconds=30)


@register(
    "recent_metrics_deep",
    with_pm(f'SELECT {PM_COLS} FROM pm ORDER BY "timestamp" DESC, id DESC LIMIT 100 OFFSET (SELECT count(*) // 2 FROM pm)'),
)
def q_recent_metrics_deep(spark, sf_dir):
    """A page in the middle of all rows, found by counts."""
    pm = load_pm(spark, sf_dir)
    n = pm.count()
    return _plain(L.metrics_page(pm, n // 2, 100))


@register(
    "recent_metrics_next",
    with_pm(f'SELECT {PM_COLS} FROM pm ORDER BY "timestamp" DESC, id DESC LIMIT 50 OFFSET 250'),
)
def q_recent_metrics_next(spark, sf_dir):
    """The page after the one that ends with the 250th row, by that row's time and id."""
    table = _stored(spark, sf_dir, 1)
    # One row: the last of the page before.
    last = L.metrics_page(table.scan(), 249, 1).select(S.TS, S.ID).first()
    return _plain(L.next_page(table.scan(), tuple(last), 50) if last else table.scan())


#: Sums of doubles differ in their last bits by the order of their terms; a shift before rounding keeps halves on one side.
_TREND = """
SELECT {bucket} AS hour_bucket, target_host, round(AVG(response_time_ms) + 1e-9, 6) AS avg_response_time, COUNT(*) AS packet_count,
       round(CAST(COUNT(*) FILTER (WHERE packet_loss = TRUE) AS DOUBLE) / COUNT(*) * 100 + 1e-9, 6) AS packet_loss_rate,
       MIN(response_time_ms) AS min_response_time, MAX(response_time_ms) AS max_response_time
FROM pm GROUP BY 1, 2"""


def _rolled(spark, sf_dir) -> R.Rollup:
    """A rollup kept through three writes, the last of them late rows, a compaction and refreshes between."""
    base = _run_dir(spark, "rollup")
    table = MetricTable(spark, f"{base}/facts")
    rollup = R.Rollup(spark, f"{base}/rollup", table)
    pm = load_pm(spark, sf_dir)
    late = (F.to_date(S.TS) == F.lit((AS_OF - timedelta(days=9)).date())) & (F.pmod(F.col(S.ID), F.lit(2)) == 0)
    table.append(pm.where(F.col(S.TS) < F.lit(AS_OF - timedelta(days=6))).where(~late), "load", 0)
    rollup.refresh()
    table.append(pm.where(F.col(S.TS) >= F.lit(AS_OF - timedelta(days=6))), "load", 1)
    rollup.refresh()
    table.compact()
    table.append(pm.where(late), "load", 2)
    rollup.refresh()
    return rollup


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("avg_response_time", "packet_loss_rate")})


@register("rollup_daily", with_pm(_TREND.format(bucket="date_trunc('day', \"timestamp\")::TIMESTAMP")))
def q_rollup_daily(spark, sf_dir):
    """Daily trend from the kept hourly partials."""
    return _rounded(R.trend(_rolled(spark, sf_dir).scan(), "day"))


@register("rollup_weekly", with_pm(_TREND.format(bucket="date_trunc('week', \"timestamp\")::TIMESTAMP")))
def q_rollup_weekly(spark, sf_dir):
    """Weekly trend from the kept hourly partials."""
    return _rounded(R.trend(_rolled(spark, sf_dir).scan(), "week"))


@register("stream_latest_store", _LATEST_SQL)
def q_stream_latest_store(spark, sf_dir):
    """Latest row of each host from a store to which micro-batches add changed hosts only; folded after the third."""
    base = _run_dir(spark, "latest-store")
    store = latest_store(spark, f"{base}/store")

    def sink(batch: DataFrame, number: int) -> None:
        put_latest(store, batch, "stream", number)
        if number == 2:
            store.fold()

    rows = _ntz(_metric_stream(spark, sf_dir))
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return _plain(store.current())


@register(
    "stream_cycle_store",
    with_pm(
        """
SELECT time_bucket(INTERVAL 10 SECOND, "timestamp") AS cycle_start,
       time_bucket(INTERVAL 10 SECOND, "timestamp") + INTERVAL 10 SECOND AS cycle_end,
       COUNT(*) FILTER (WHERE packet_loss = FALSE) AS successful_pings, COUNT(*) AS total_pings
FROM pm
GROUP BY 1, 2"""
    ),
)
def q_stream_cycle_store(spark, sf_dir):
    """Per-cycle success counts in a store of changed windows, folded once: one version of each window is left."""
    base = _run_dir(spark, "cycle-store")
    counts = J.stream_cycle_success(_metric_stream(spark, sf_dir), "10 seconds", lateness="1 minute")
    schema = _ntz(counts).schema
    store = KeyedStore(spark, f"{base}/store", schema, "cycle_start", ["cycle_start"])
    sink = lambda batch, number: store.put(_ntz(batch), "stream", number)
    q = counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{base}/ckpt")
    q.trigger(availableNow=True).start().awaitTermination()
    store.fold()
    return store.current()


@register(
    "stream_cycle_messages",
    _ROUTED_SQL
    + """, closed AS (SELECT max("timestamp") - INTERVAL 1 MINUTE AS upto FROM pm)
SELECT * EXCLUDE (cycle_start) FROM routed, closed WHERE cycle_start + INTERVAL 10 SECOND <= date_trunc('milliseconds', upto)""".replace("* EXCLUDE (cycle_start)", "* EXCLUDE (cycle_start, upto)"),
)
def q_stream_cycle_messages(spark, sf_dir):
    """JSON messages of the cycles that the watermark has passed, decoded again: one row for each result."""
    base = _run_dir(spark, "cycle-messages")
    C.stream_messages(_metric_stream(spark, sf_dir), f"{base}/out", f"{base}/ckpt", parts=4, trigger={"availableNow": True}).awaitTermination()
    lines = spark.read.schema("value string, route string").format("text").load(f"{base}/out")
    return _laid_out(lines.select(F.from_json("value", _MESSAGE).alias("m"), "route").select("m.*", "route"), S.TS, "type", "route")


#: Messages of three clients, made of the table's rows: some ids subscribe to the row's host, some end it.
_MESSAGES_SQL = """
WITH messages AS (
  SELECT 'client ' || (id % 3) AS client, target_host, "timestamp", id AS seq, id % 7 = 1 AS subscribe FROM pm WHERE id % 7 IN (1, 4)
), spans AS (
  SELECT *, lead("timestamp") OVER (PARTITION BY client, target_host ORDER BY "timestamp", seq) AS until FROM messages
)"""


@register(
    "stream_subscriptions",
    with_pm(
        f"""{_MESSAGES_SQL}
SELECT client, {", ".join(f"pm.{c}" for c in PM_COLS.split(", "))} FROM pm JOIN spans ON pm.target_host = spans.target_host AND subscribe
  AND pm."timestamp" >= spans."timestamp" AND (until IS NULL OR pm."timestamp" < until)"""
    ),
)
def q_stream_subscriptions(spark, sf_dir):
    """Rows delivered to the clients subscribed at their time, while subscriptions come and go in the same stream."""
    feed = U.SubscriptionFeed(spark, f"{_run_dir(spark, 'subscriptions')}/feed")
    rows = _ntz(_metric_stream(spark, sf_dir))
    kind = F.pmod(F.col(S.ID), F.lit(7))
    client = F.concat(F.lit("client "), F.pmod(F.col(S.ID), F.lit(3)).cast("string"))
    message = U.message(client, F.col(S.HOST), F.col(S.TS), F.col(S.ID), kind == 1)
    feed.start(rows.select(U.fact().alias("row"), F.when(kind.isin(1, 4), message).alias("message")), {"availableNow": True}).awaitTermination()
    return feed.rows()
