"""Reading and writing the probe fact table.

Storage layout: Parquet partitioned by ``metric_date`` (= date of
``timestamp``), rows clustered by ``(target_host, timestamp)`` inside each
date so row-group min/max statistics skip data for host and time predicates.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwatch import schema as S
from linkwatch.functions.timefns import ts_literal


def pm_from_events(events: DataFrame) -> DataFrame:
    """Map the driver's ``events`` table onto the probe fact layout.

    host = watchlist[user_id % 5]; a probe is lost when event_type = 'error';
    a lost probe has no response time and the fixed error text.
    """
    idx = F.pmod(F.col("user_id"), F.lit(len(S.DEFAULT_HOSTS)))
    host = F.element_at(F.array(*[F.lit(h) for h in S.DEFAULT_HOSTS]), (idx + 1).cast("int"))
    lost = F.col("event_type") == F.lit("error")
    return events.select(
        F.col("event_id").alias(S.ID),
        F.col("ts").cast("timestamp_ntz").alias(S.TS),
        host.alias(S.HOST),
        F.when(lost, F.lit(None).cast("double")).otherwise(F.col("value")).alias(S.RT),
        lost.alias(S.LOSS),
        F.when(lost, F.lit(S.LOSS_MESSAGE)).alias(S.ERR),
        F.col("ts").cast("timestamp_ntz").alias(S.CREATED),
    )


# Schema of the driver's ``events`` table (read without inference).
EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType(), True),
        T.StructField("ts", T.TimestampNTZType(), True),
        T.StructField("user_id", T.LongType(), True),
        T.StructField("event_type", T.StringType(), True),
        T.StructField("value", T.DoubleType(), True),
        T.StructField("props", T.StringType(), True),
    ]
)


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def load_pm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table derived from ``{sf_dir}/events.parquet``."""
    return pm_from_events(load_events(spark, sf_dir))


def scan_metrics(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """Read the stored fact table with its fixed schema (no inference).

    ``since`` becomes both a partition filter on ``metric_date`` (Spark does
    not derive it from the timestamp predicate) and a pushed row filter.
    """
    schema = T.StructType(list(S.METRICS_SCHEMA.fields) + [T.StructField(S.METRIC_DATE, T.DateType(), True)])
    df = spark.read.schema(schema).parquet(path).drop(BATCH)
    if since is not None:
        df = df.where(F.col(S.METRIC_DATE) >= F.lit(since.date())).where(F.col(S.TS) >= ts_literal(since))
    return df


#: Second level of the stored folders: the write that a file came with.
BATCH = "batch"


def keyed(df: DataFrame) -> DataFrame:
    """Rows with an ``id``: that of the row, or else a hash of host, time and result.

    Every writer uses this rule. The hash needs no stored maximum and no lock, and
    a row that is written again gets the same id.
    """
    made = F.xxhash64(S.HOST, S.TS, S.RT, S.LOSS, S.ERR).bitwiseAND(F.lit(2**63 - 1))
    given = F.col(S.ID).cast("long") if S.ID in df.columns else F.lit(None).cast("long")
    return df.withColumn(S.ID, F.coalesce(given, made))


def next_id(spark: SparkSession, path: str) -> int:
    """The id after the greatest stored one, for ``assign_ids(start=...)``; 1 for an empty table."""
    top = scan_metrics(spark, path).agg(F.max(S.ID)).first()[0]  # one value
    return 1 if top is None else int(top) + 1


def with_metric_date(df: DataFrame) -> DataFrame:
    return df.withColumn(S.METRIC_DATE, F.to_date(F.col(S.TS)))


def append_metrics(df: DataFrame, path: str, mode: str = "append", batch: str | None = None) -> None:
    """Append fact rows as date-partitioned, host/time-clustered Parquet.

    Rows without ``id`` get one (``keyed``). The write rebalances by date: small
    days share a task, a hot day is split over several, and each task sorts by
    host and time, so row-group statistics are tight. Every write has a ``batch``
    folder under each date; writing the same batch again replaces it, so a
    repeated micro-batch adds nothing. Batch and stream writers share a table.
    """
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    log = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_spark_metadata")
    if log.getFileSystem(conf).exists(log):
        raise ValueError(f"{path} was written by a file sink, whose log hides files of other writers")
    out = with_metric_date(keyed(df).select(*S.METRIC_COLUMNS)).withColumn(BATCH, F.lit(f"b-{batch or uuid.uuid4().hex}"))
    out = out.hint("rebalance", S.METRIC_DATE).sortWithinPartitions(S.METRIC_DATE, S.HOST, S.TS, S.ID)
    kind = "static" if mode == "overwrite" else "dynamic"
    out.write.mode("overwrite").option("partitionOverwriteMode", kind).partitionBy(S.METRIC_DATE, BATCH).parquet(path)


def seed_rows(spark: SparkSession, as_of: datetime = S.FIXTURE_AS_OF) -> DataFrame:
    """The three sample rows of the table definition, stamped at ``as_of``."""
    rows = [
        (i + 1, as_of, host, rt, False, None, as_of) for i, (host, rt) in enumerate(S.SEED_ROWS)
    ]
    return spark.createDataFrame(rows, S.METRICS_SCHEMA)


def apply_retention(spark: SparkSession, path: str, as_of: datetime, days: int = 30) -> int:
    """Delete rows older than ``as_of - days`` from the stored table; returns
    the number of deleted rows.

    Dates wholly before the cutoff are dropped as whole ``metric_date``
    folders; the one date that straddles the cutoff is rewritten: its kept
    rows go to a staging folder next to the table (never the folder being
    read), then replace the old folder. The swap is two renames: atomic each on a
    file system, but copies on most object stores, where a reader may meanwhile
    find the date missing; run it there while no reader is active.
    """
    from datetime import timedelta

    cutoff = as_of - timedelta(days=days)
    table = scan_metrics(spark, path)
    old = table.where(F.col(S.METRIC_DATE) <= F.lit(cutoff.date())).where(F.col(S.TS) < ts_literal(cutoff))
    stats = old.groupBy(S.METRIC_DATE).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per date
    if not stats:
        return 0
    deleted = int(sum(r["n"] for r in stats))
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    boundary = cutoff.date()
    for r in stats:
        d = r[S.METRIC_DATE]
        if d < boundary:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{S.METRIC_DATE}={d.isoformat()}"), True)
    if any(r[S.METRIC_DATE] == boundary for r in stats):
        part = f"{path.rstrip('/')}/{S.METRIC_DATE}={boundary.isoformat()}"
        staging = f"{path.rstrip('/')}_staging_{boundary.isoformat()}"
        keep = (
            spark.read.schema(S.METRICS_SCHEMA).parquet(part)
            .where(F.col(S.TS) >= ts_literal(cutoff))
            .sortWithinPartitions(S.HOST, S.TS, S.ID)
        )
        keep.write.mode("overwrite").partitionBy(*[c for c in (BATCH,) if c in keep.columns]).parquet(staging)
        # Swap without a window in which the date's rows exist nowhere: the
        # old folder is moved aside first and removed only after the new one
        # is in place (a failure in between leaves both copies on storage).
        backup = f"{staging}_old"
        P = jvm.org.apache.hadoop.fs.Path
        if not fs.rename(P(part), P(backup)):
            raise IOError(f"could not move {part} aside")
        if not fs.rename(P(staging), P(part)):
            fs.rename(P(backup), P(part))
            raise IOError(f"could not move the rewritten {part} into place")
        fs.delete(P(backup), True)
    return deleted

