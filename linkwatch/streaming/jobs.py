"""Structured Streaming versions of the ingest loop and the live operators.

Streams carry event time as TIMESTAMP (watermarks need it); the batch
tables keep TIMESTAMP_NTZ. Late policy: ``lateness`` (default 1 hour) —
aggregates drop rows older than the watermark, ingest stores them anyway.
"""

from __future__ import annotations

import zlib
from datetime import datetime
from typing import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from linkwatch import schema as S
from linkwatch.functions.timefns import ts_literal, utc_now
from linkwatch.operators import downtime as D
from linkwatch.operators.latest import latest_rows
from linkwatch.session import ship_package
from linkwatch.sources.ingest import normalize_probe
from linkwatch.sources.metrics import append_metrics

STREAM_METRICS_SCHEMA = T.StructType(
    [
        T.StructField(S.ID, T.LongType(), True),
        T.StructField(S.TS, T.TimestampType(), True),
        T.StructField(S.HOST, T.StringType(), True),
        T.StructField(S.RT, T.DoubleType(), True),
        T.StructField(S.LOSS, T.BooleanType(), True),
        T.StructField(S.ERR, T.StringType(), True),
        T.StructField(S.CREATED, T.TimestampType(), True),
    ]
)


# ---------------------------------------------------------------------------
# sources
# ---------------------------------------------------------------------------
def read_metric_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = 1) -> DataFrame:
    """Stream of fact rows from a Parquet folder (fixed schema, TIMESTAMP time)."""
    r = spark.readStream.schema(_ntz_schema(STREAM_METRICS_SCHEMA))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.parquet(path)
    return df.select(
        *[F.col(c).cast("timestamp").alias(c) if c in (S.TS, S.CREATED) else F.col(c) for c in STREAM_METRICS_SCHEMA.names]
    )


def read_probe_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = 1,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Stream of raw prober results (``host, response_time_ms, packet_loss,
    error_message, timestamp`` text, plus any extra columns given in
    ``schema``; default: the raw probe schema)."""
    r = spark.readStream.format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.schema(schema or S.RAW_PROBE_SCHEMA).load(path)


def _ntz_schema(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType) else f.dataType, True)
            for f in schema.fields
        ]
    )


def to_event_time(df: DataFrame) -> DataFrame:
    """Cast NTZ time columns to TIMESTAMP (session zone UTC) for watermarks."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# ---------------------------------------------------------------------------
# T-1 ingest
# ---------------------------------------------------------------------------
def ingest_rows(raw: DataFrame) -> DataFrame:
    """Raw results -> fact rows with ``created_at`` (processing time)."""
    return normalize_probe(raw).withColumn(S.CREATED, utc_now())


def _append_batches(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    """Append a stream of fact rows through the batch writer, one batch folder for
    each micro-batch; a micro-batch that runs again replaces its folder."""
    name = f"{zlib.crc32(checkpoint.encode()):08x}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        append_metrics(batch, path, batch=f"{name}-{batch_id}")

    w = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def stream_ingest(
    raw: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Normalise raw probe results and append them to the fact table.

    Same schema, ids and layout as ``append_metrics``, so all operators read
    the table and batch writers may append to it too. ``created_at`` is the
    processing time, ``timestamp`` the probe's event time. ``trigger`` e.g.
    ``{"processingTime": "10 seconds"}`` or ``{"availableNow": True}``.
    """
    return _append_batches(ingest_rows(raw), path, checkpoint, trigger)


def json_ingest_frames(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fact rows, rejects) from JSON request lines (column ``value``)."""
    from linkwatch.sources.ingest import parse_probe_json

    valid, rejects = parse_probe_json(lines, "value")
    now = utc_now()
    rows = valid.select(
        S.HOST,
        S.RT,
        F.coalesce(F.col(S.LOSS), F.lit(False)).alias(S.LOSS),
        S.ERR,
        now.alias(S.TS),
        now.alias(S.CREATED),
    )
    return rows, rejects


def stream_ingest_json(
    spark: SparkSession,
    src_path: str,
    table_path: str,
    rejects_path: str,
    checkpoint_base: str,
    trigger: dict | None = None,
    max_files_per_trigger: int | None = 1,
) -> tuple[StreamingQuery, StreamingQuery]:
    """JSON insert requests (one per line) -> fact table + rejects table.

    Lines are decoded with ``parse_probe_json``; valid requests get the
    column defaults with the processing time as ``timestamp`` and
    ``created_at`` (the insert time, like the source service) and are
    appended to the date-partitioned table; undecodable lines and requests
    without a host go to ``rejects_path`` with their reason.
    """
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    rows, rejects = json_ingest_frames(r.load(src_path))
    trig = trigger or {"processingTime": "10 seconds"}
    q_rows = _append_batches(rows, table_path, f"{checkpoint_base}/rows", trig)
    q_rej = (
        rejects.writeStream.format("parquet")
        .option("path", rejects_path)
        .option("checkpointLocation", f"{checkpoint_base}/rejects")
        .trigger(**trig)
        .start()
    )
    return q_rows, q_rej


# ---------------------------------------------------------------------------
# T-2 latest state
# ---------------------------------------------------------------------------
def stream_latest(src: DataFrame) -> DataFrame:
    """Latest row per host as a streaming aggregate (``update`` / ``complete`` mode)."""
    cols = [c for c in S.METRIC_COLUMNS if c in src.columns]
    agg = src.groupBy(S.HOST).agg(F.max_by(F.struct(*cols), F.struct(S.TS, S.ID)).alias("_row"))
    return agg.select(*[F.col(f"_row.{c}").alias(c) for c in cols])


def write_latest_table(latest: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep a snapshot of the latest-per-host state: a folder for each
    micro-batch (``read_versions`` finds the newest), never overwritten in place."""
    return _write_versions(latest, path, checkpoint, "complete", trigger)


def _write_versions(df: DataFrame, path: str, checkpoint: str, mode: str, trigger: dict | None) -> StreamingQuery:
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    w = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def read_versions(spark: SparkSession, path: str, keys: Iterable[str] | None = None) -> DataFrame:
    """What ``_write_versions`` has kept: the newest snapshot or, with ``keys``
    (sinks of changed rows), the newest row of each key."""
    rows = spark.read.parquet(path)
    if keys is None:
        newest = rows.agg(F.max("version")).first()[0]  # one value, from folder names
        return rows.where(F.col("version") == F.lit(newest)).drop("version")
    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "version")


# ---------------------------------------------------------------------------
# T-3 / T-5 windowed aggregates
# ---------------------------------------------------------------------------
def stream_cycle_success(src: DataFrame, interval: str = "10 seconds", lateness: str = "1 hour") -> DataFrame:
    """Successful / total probes per cycle window; append mode emits a
    window once the watermark passes its end."""
    w = F.window(S.TS, interval)
    agg = src.withWatermark(S.TS, lateness).groupBy(w.alias("cycle")).agg(
        F.count_if(F.col(S.LOSS) == F.lit(False)).alias("successful_pings"),
        F.count(F.lit(1)).alias("total_pings"),
    )
    return agg.select(
        F.col("cycle.start").alias("cycle_start"),
        F.col("cycle.end").alias("cycle_end"),
        "successful_pings",
        "total_pings",
    )


def stream_hourly_stats(src: DataFrame, lateness: str = "1 hour", unit: str = "1 hour") -> DataFrame:
    """Hourly statistics per host on a stream (loss rate in percent)."""
    w = F.window(S.TS, unit)
    agg = src.withWatermark(S.TS, lateness).groupBy(w.alias("_w"), F.col(S.HOST)).agg(
        F.avg(S.RT).alias("avg_response_time"),
        F.count(F.lit(1)).alias("packet_count"),
        F.count_if(F.col(S.LOSS) == F.lit(True)).alias("_losses"),
    )
    return agg.select(
        F.col("_w.start").alias("hour_bucket"),
        S.HOST,
        "avg_response_time",
        "packet_count",
        (F.try_divide(F.col("_losses").cast("double"), F.col("packet_count").cast("double")) * F.lit(100.0)).alias(
            "packet_loss_rate"
        ),
    )


# ---------------------------------------------------------------------------
# T-4 routing, T-7 subscriptions
# ---------------------------------------------------------------------------
def stream_dns_route(src: DataFrame, host_col: str = S.HOST) -> DataFrame:
    """Tag each row with its feed: ``route`` = ``dns`` for resolver hosts, else ``all``;
    ``message_type`` the live-feed type."""
    is_dns = F.col(host_col).isin(*S.DNS_HOSTS)
    return src.select(
        "*",
        F.when(is_dns, F.lit("dns")).otherwise(F.lit("all")).alias("route"),
        F.when(is_dns, F.lit(S.MSG_DNS_UPDATE)).otherwise(F.lit(S.MSG_PING_UPDATE)).alias("message_type"),
    )


def start_feeds(routed: DataFrame, dns_path: str, all_path: str, checkpoint_base: str, trigger: dict | None = None):
    """Two exactly-once file sinks: the DNS feed and the full feed."""
    trig = trigger or {"processingTime": "10 seconds"}
    dns = (
        routed.where(F.col("route") == F.lit("dns"))
        .writeStream.format("parquet")
        .option("path", dns_path)
        .option("checkpointLocation", f"{checkpoint_base}/dns")
        .trigger(**trig)
        .start()
    )
    full = (
        routed.writeStream.format("parquet")
        .option("path", all_path)
        .option("checkpointLocation", f"{checkpoint_base}/all")
        .trigger(**trig)
        .start()
    )
    return dns, full


def stream_host_filter(src: DataFrame, subscriptions: DataFrame | Iterable[str]) -> DataFrame:
    """Rows of subscribed hosts only (stream-static left-semi join)."""
    if not isinstance(subscriptions, DataFrame):
        from linkwatch.operators.stats import host_list

        subscriptions = host_list(src.sparkSession, subscriptions)
    return src.join(subscriptions.select(S.HOST), on=S.HOST, how="left_semi")


# ---------------------------------------------------------------------------
# T-6 stateful outage detection
# ---------------------------------------------------------------------------
DOWNTIME_OUT_SCHEMA = T.StructType(
    [
        T.StructField(S.HOST, T.StringType(), True),
        T.StructField("start_time", T.TimestampType(), True),
        T.StructField("end_time", T.TimestampType(), True),
        T.StructField("duration_seconds", T.DoubleType(), True),
    ]
)

DOWNTIME_STATE_SCHEMA = T.StructType(
    [
        T.StructField("seen", T.BooleanType(), True),
        T.StructField("last_loss", T.BooleanType(), True),
        T.StructField("last_ts_us", T.LongType(), True),
        T.StructField("last_id", T.LongType(), True),
        T.StructField("pending", T.ArrayType(T.LongType()), True),
        T.StructField("late_rows", T.LongType(), True),
    ]
)


_CARRY_SCHEMA = "seen boolean, last_loss boolean, last_ts_us bigint, last_id bigint, late_rows bigint"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _outage_core(min_duration_seconds: float):
    """The per-host outage state machine as a closure.

    Built inside a function and referring only to numpy, pandas and closure
    constants, so Spark ships it to Python workers by value (no import of
    this package is needed there, also not in the driver-side worker that
    ``transformWithStateInPandas`` starts).

    ``advance(host, pdf, carry, pending)``: ``carry`` = (seen, last_loss,
    last_ts_us, last_id, late_rows); ``pending`` = unmatched start times
    (µs), oldest first. The n-th start pairs with the n-th end, as in the
    batch operator. Rows are sorted by (timestamp, id); rows not newer than
    the last processed row of the host are counted in ``late_rows`` and
    skipped (their history has been emitted already). Returns (outages,
    carry, pending).
    """
    import numpy as np
    import pandas as pd

    ts_col, id_col, loss_col, host_col = S.TS, S.ID, S.LOSS, S.HOST
    out_cols = list(DOWNTIME_OUT_SCHEMA.names)
    min_d = float(min_duration_seconds)

    def to_us(ts):
        t = pd.to_datetime(ts)
        if getattr(t.dt, "tz", None) is not None:
            t = t.dt.tz_convert("UTC").dt.tz_localize(None)
        return t.astype("datetime64[us]").astype("int64").to_numpy()

    def advance(host, pdf, carry, pending):
        seen, last_loss, last_ts, last_id, late = carry
        late = int(late or 0)
        ts = to_us(pdf[ts_col])
        ids = pdf[id_col].to_numpy(dtype="int64")
        flag = pdf[loss_col].astype("boolean")
        order = np.lexsort((ids, ts))
        ts, ids = ts[order], ids[order]
        flag = flag.iloc[order].reset_index(drop=True)
        if seen and last_ts is not None:
            newer = (ts > last_ts) | ((ts == last_ts) & (ids > last_id))
            late += int((~newer).sum())
            ts, ids, flag = ts[newer], ids[newer], flag[newer].reset_index(drop=True)
        out = pd.DataFrame({c: [] for c in out_cols})
        if len(ts):
            is_true = flag.fillna(False).to_numpy(dtype=bool)
            is_false = (~flag).fillna(False).to_numpy(dtype=bool)
            prev_true = np.empty(len(ts), dtype=bool)
            prev_true[0] = bool(seen and last_loss is True)
            prev_true[1:] = is_true[:-1]
            # start: loss AND (prev FALSE or NULL or none); end: not loss AND prev TRUE
            starts = ts[is_true & ~prev_true]
            ends = ts[is_false & prev_true]
            queue = np.concatenate([np.asarray(pending, dtype="int64"), starts])
            k = min(len(queue), len(ends))
            s_us, e_us = queue[:k], ends[:k]
            pending = [int(x) for x in queue[k:]]
            dur = (e_us - s_us) / 1e6
            keep = dur >= min_d
            out = pd.DataFrame(
                {
                    host_col: host,
                    "start_time": pd.to_datetime(s_us[keep], unit="us"),
                    "end_time": pd.to_datetime(e_us[keep], unit="us"),
                    "duration_seconds": dur[keep],
                }
            )[out_cols]
            last = flag.iloc[-1]
            last_loss = None if pd.isna(last) else bool(last)
            last_ts, last_id, seen = int(ts[-1]), int(ids[-1]), True
        return out, (seen, last_loss, last_ts, last_id, late), pending

    return advance


def _outage_state_fn(min_duration_seconds: float):
    """``applyInPandasWithState`` function: state is one row per host."""
    import pandas as pd

    advance = _outage_core(min_duration_seconds)

    def fn(key, pdfs, state):
        if state.exists:
            seen, last_loss, last_ts, last_id, pending, late = state.get
            carry, pending = (seen, last_loss, last_ts, last_id, late), list(pending or [])
        else:
            carry, pending = (False, None, None, None, 0), []
        pdf = pd.concat(list(pdfs), ignore_index=True)
        out, carry, pending = advance(key[0], pdf, carry, pending)
        seen, last_loss, last_ts, last_id, late = carry
        state.update((seen, last_loss, last_ts, last_id, pending, late))
        yield out

    return fn


def outage_processor(min_duration_seconds: float = 30) -> StatefulProcessor:
    """``transformWithStateInPandas`` processor: the host's carry in a value
    state, its unmatched starts in a list state (RocksDB-backed). The class
    is created here so it is shipped by value like ``_outage_core``."""
    import pandas as pd

    advance = _outage_core(min_duration_seconds)
    carry_schema = _CARRY_SCHEMA

    class _OutageProcessor(StatefulProcessor):
        def init(self, handle) -> None:
            self.carry = handle.getValueState("carry", carry_schema)
            self.pending = handle.getListState("pending", "start_us bigint")

        def handleInputRows(self, key, rows, timerValues):
            carry = tuple(self.carry.get()) if self.carry.exists() else (False, None, None, None, 0)
            pending = [int(r[0]) for r in self.pending.get()] if self.pending.exists() else []
            pdf = pd.concat(list(rows), ignore_index=True)
            out, carry, pending = advance(key[0], pdf, carry, pending)
            self.carry.update(carry)
            if pending:
                self.pending.put([(p,) for p in pending])
            else:
                self.pending.clear()
            yield out

        def close(self) -> None:
            pass

    return _OutageProcessor()


def stream_downtime_keyed(src: DataFrame, min_duration_seconds: float = 30, api: str = "group_state") -> DataFrame:
    """Outages of a feed that comes in time order for each host, by keyed state: an
    outage is emitted on the row that ends it (append mode). Rows older than the
    last one seen of their host are skipped; for feeds with disorder or hot hosts
    use ``stream_downtime``. Keyed state per host holds the last flag and the
    unmatched starts, so memory is per host, not per row. A micro-batch's
    rows of one host are processed together (bound them with the source's
    ``maxFilesPerTrigger`` / ``maxBytesPerTrigger`` / ``maxOffsetsPerTrigger``).

    ``api="group_state"`` uses ``applyInPandasWithState``;
    ``api="processor"`` uses ``transformWithStateInPandas`` with the RocksDB
    state store, which the caller configures.
    """
    spark = src.sparkSession
    ship_package(spark)
    rows = src.select(S.HOST, S.TS, S.ID, S.LOSS)
    if api == "processor":
        if ROCKSDB_PROVIDER not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
            raise ValueError(f"api='processor' needs spark.sql.streaming.stateStore.providerClass={ROCKSDB_PROVIDER}")
        return rows.groupBy(S.HOST).transformWithStateInPandas(
            outage_processor(min_duration_seconds), DOWNTIME_OUT_SCHEMA, "Append", "None"
        )
    if api != "group_state":
        raise ValueError("api must be 'group_state' or 'processor'")
    return rows.groupBy(S.HOST).applyInPandasWithState(
        _outage_state_fn(min_duration_seconds),
        DOWNTIME_OUT_SCHEMA,
        DOWNTIME_STATE_SCHEMA,
        "append",
        GroupStateTimeout.NoTimeout,
    )


class OutageFeed:
    """Outages of a stream whose rows may come late or in any order.

    Rows wait until the watermark (newest event time less ``lateness``) has
    passed them; then they go through the batch operator in event-time order,
    chunked by host and time, with one carried row for each host: where its open
    outage began, or its last probe. Rows from before the watermark come too
    late; they are stored in ``late`` and change nothing. Null flags count as
    not lost, as at ingest.

    Folders under ``path``: ``outages`` and ``late``, each with a folder for each
    micro-batch, and ``state`` (waiting rows, carried rows and watermark), of which
    the last two are kept. A micro-batch that runs again starts from the state
    before it and replaces its folders. Its rows are read from the source once.
    """

    def __init__(self, spark: SparkSession, path: str, min_duration_seconds: float = 30, lateness: str = "1 hour", chunk_unit: str = "hour"):
        self.spark, self.path = spark, path.rstrip("/")
        self.min_duration_seconds, self.lateness, self.chunk_unit = min_duration_seconds, lateness, chunk_unit

    _ROWS = f"{S.HOST} string, {S.TS} timestamp_ntz, {S.ID} bigint, {S.LOSS} boolean"

    def start(self, src: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        rows = src.select(S.HOST, F.col(S.TS).cast("timestamp_ntz").alias(S.TS), S.ID, F.coalesce(S.LOSS, F.lit(False)).alias(S.LOSS))
        w = rows.writeStream.foreachBatch(lambda batch, i: self._advance(batch, i)).option("checkpointLocation", f"{self.path}/checkpoint")
        return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()

    def _state(self, version: int) -> tuple[DataFrame, DataFrame, object]:
        """(waiting, carried, watermark) after a micro-batch; -1: none yet."""
        if version < 0:
            none = self.spark.createDataFrame([], self._ROWS)
            return none, none, None
        at = f"{self.path}/state/version={version}"
        mark = self.spark.read.schema("watermark timestamp_ntz").parquet(f"{at}/watermark").first()
        read = self.spark.read.schema(self._ROWS)
        return read.parquet(f"{at}/waiting"), read.parquet(f"{at}/carried"), mark[0] if mark else None

    def _advance(self, batch: DataFrame, version: int, flush: bool = False) -> None:
        # The source is read once, though several writes need its rows.
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            self._step(batch, version, flush)
        finally:
            batch.unpersist()
        # What this micro-batch needed in between, and states that no second try begins from.
        self._drop(f"work/version={version}")
        self._drop(f"state/version={version - 2}")

    def _drop(self, what: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _step(self, batch: DataFrame, version: int, flush: bool) -> None:
        waiting, carried, mark = self._state(version - 1)
        put = lambda df, what: df.write.mode("overwrite").parquet(f"{self.path}/{what}")
        late = batch.where(F.col(S.TS) < ts_literal(mark)) if mark else batch.where("false")
        put(late, f"late/version={version}")
        fresh = waiting.unionByName(batch.where(F.col(S.TS) >= ts_literal(mark)) if mark else batch)
        newest = fresh.agg((F.max(S.TS) - F.expr(f"INTERVAL {self.lateness}")).alias("w")).first()["w"]  # one value
        mark = max((m for m in (mark, newest) if m), default=None)
        released = fresh if flush else fresh.where(F.col(S.TS) < ts_literal(mark)) if mark else fresh.where("false")
        rows = carried.unionByName(released).withColumns({S.RT: F.lit(None).cast("double")})
        every = D.downtime_periods(rows, hours=None, min_duration_seconds=0, chunk_unit=self.chunk_unit, as_of=_FAR, include_open=True)
        put(every, f"work/version={version}")
        every = self.spark.read.schema(every.schema).parquet(f"{self.path}/work/version={version}")
        closed = every.where(F.col("end_time").isNotNull() & (F.col("duration_seconds") >= F.lit(float(self.min_duration_seconds))))
        put(closed, f"outages/version={version}")
        # Carried on: the begin of an open outage, or else the host's last row.
        last = latest_rows(rows.drop(S.RT))
        begun = every.where(F.col("end_time").isNull()).select(S.HOST, F.col("start_time").alias("_begin"))
        onward = last.join(begun, S.HOST, "left").select(S.HOST, F.coalesce("_begin", S.TS).alias(S.TS), S.ID, S.LOSS)
        at = f"state/version={version}"
        put(onward, f"{at}/carried")
        put(fresh.where("false") if flush else fresh.where(F.col(S.TS) >= ts_literal(mark)) if mark else fresh, f"{at}/waiting")
        put(self.spark.createDataFrame([(mark,)], "watermark timestamp_ntz"), f"{at}/watermark")

    def flush(self) -> None:
        """Release what still waits, at the end of a finite feed."""
        version = self._last_version() + 1
        self._advance(self.spark.createDataFrame([], self._ROWS), version, flush=True)

    def _last_version(self) -> int:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        fs = root.getFileSystem(conf)
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return max((int(n.partition("=")[2]) for n in names), default=-1)

    def outages(self) -> DataFrame:
        schema = f"{S.HOST} string, start_time timestamp_ntz, end_time timestamp_ntz, duration_seconds double"
        return self.spark.read.schema(schema).parquet(f"{self.path}/outages").drop("version")

    def late_rows(self) -> DataFrame:
        return self.spark.read.schema(self._ROWS).parquet(f"{self.path}/late").drop("version")


#: Open outages are measured up to here; only their begin is used.
_FAR = datetime(9999, 1, 1)


def stream_downtime(src: DataFrame, path: str, min_duration_seconds: float = 30, lateness: str = "1 hour", trigger: dict | None = None) -> tuple[OutageFeed, StreamingQuery]:
    """Outages detected continuously, right under disorder up to ``lateness``: see ``OutageFeed``."""
    feed = OutageFeed(src.sparkSession, path, min_duration_seconds, lateness)
    return feed, feed.start(src, trigger)


def downtime_of_feed(src: DataFrame, path: str, min_duration_seconds: float = 30, lateness: str = "1 hour") -> OutageFeed:
    """``stream_downtime`` over what the source holds now, to the end."""
    feed, q = stream_downtime(src, path, min_duration_seconds, lateness, {"availableNow": True})
    q.awaitTermination()
    feed.flush()
    return feed


def stream_downtime_alerts(src: DataFrame, path: str, min_hours: float, lateness: str = "1 hour", trigger: dict | None = None) -> tuple[OutageFeed, StreamingQuery]:
    """Alert feed: outages of at least ``min_hours`` hours, written when they end."""
    return stream_downtime(src, path, float(min_hours) * 3600.0, lateness, trigger)


# ---------------------------------------------------------------------------
# helpers for finite runs (tests, registered queries)
# ---------------------------------------------------------------------------
def run_available_now(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process everything currently in the source, write to ``path``, stop."""
    if mode == "append":
        q = (
            df.writeStream.format(fmt)
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    else:
        # Read the result with ``read_versions``.
        q = _write_versions(df, path, checkpoint, mode, {"availableNow": True})
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
