"""Subscriptions that change while a stream runs.

A client subscribes to a host and unsubscribes by messages with a time of their
own. A row goes to every client whose newest message for its host, up to the
row's time, is a subscription: an as-of join.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from linkwatch import schema as S
from linkwatch.sources.versions import VersionedTable

CLIENT, SUBSCRIBE = "client", "subscribe"
MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField(CLIENT, T.StringType(), True),
        T.StructField(S.HOST, T.StringType(), True),
        T.StructField(S.TS, T.TimestampNTZType(), True),
        T.StructField("seq", T.LongType(), True),
        T.StructField(SUBSCRIBE, T.BooleanType(), True),
    ]
)
#: Rows of a host that share a slot of its time, about; parts of a host's time with equal numbers of rows, at most.
SHARED, PARTS = 256, 1024
DELIVERED_SCHEMA = T.StructType([T.StructField(CLIENT, T.StringType(), True), *S.METRICS_SCHEMA.fields])


def subscription_spans(messages: DataFrame) -> DataFrame:
    """(client, target_host, begin, end): when each subscription holds; ``end`` is null while it does.

    Messages of one time count in the order of ``seq``. A window has the messages
    of one client about one host.
    """
    w = Window.partitionBy(CLIENT, S.HOST).orderBy(S.TS, "seq")
    spans = messages.withColumn("end", F.lead(S.TS).over(w)).where(F.col(SUBSCRIBE))
    return spans.select(CLIENT, S.HOST, F.col(S.TS).alias("begin"), "end").where(F.col("end").isNull() | (F.col("end") > F.col("begin")))


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def host_slots(rows: DataFrame) -> DataFrame:
    """(_host, low, high, edges, per): how the time of each host of ``rows`` is cut into slots of about ``SHARED`` rows.

    ``edges`` begin and end parts of about as many rows each (microseconds, at
    most ``PARTS`` parts); a part has ``per`` slots of equal length.
    """
    n, cuts = F.col("_n"), F.col("_cuts")
    shares = [k / PARTS for k in range(1, PARTS)]
    known = rows.where(F.col(S.HOST).isNotNull() & F.col(S.TS).isNotNull()).select(F.col(S.HOST).alias("_host"), _micros(S.TS).alias("_at"))
    found = known.groupBy("_host").agg(F.count("*").alias("_n"), F.min("_at").alias("low"), F.max("_at").alias("high"), F.percentile_approx("_at", shares, 10_000).alias("_cuts"))
    parts = F.least(F.lit(PARTS), F.ceil(n / SHARED)).cast("int")
    inner = F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.get(cuts, F.floor(k * PARTS / parts).cast("int") - 1))
    inner = F.when(parts > 1, inner).otherwise(F.array().cast("array<bigint>"))
    edges = F.array_distinct(F.concat(F.array("low"), inner, F.array(F.col("high") + 1)))
    return found.select("_host", "low", "high", edges.alias("edges"), F.ceil(n / (SHARED * PARTS)).alias("per"))


def _slotted(df: DataFrame, at: Column, name: str) -> DataFrame:
    """``df``, with ``edges`` and ``per`` of its hosts, with the slot of a time between ``low`` and ``high``. Later times are in no earlier slot."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((PARTS + 1).bit_length()))])
    # The number of edges that are not above the time, by halving.
    upto = F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.get("edges", i + step - 1) <= F.col("_at"), i + step).otherwise(i))
    df = df.withColumn("_at", at).withColumn("_part", upto - 1)
    begin, end = F.get("edges", F.col("_part")), F.get("edges", F.col("_part") + 1)
    slot = F.floor((F.col("_at") - begin) / (end - begin) * F.col("per"))
    return df.withColumn(name, F.col("_part") * F.col("per") + F.least(slot, F.col("per") - 1)).drop("_at", "_part")


def dealt(rows: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_slot``, and the spans of ``messages`` (client, _host, begin, end, _slot) once for each slot with rows that they reach into."""
    hosts = host_slots(rows)
    # A host with few rows has one slot. Others have an entry for each SHARED rows at most.
    many = hosts.where(F.size("edges") > 2).select(F.col("_host").alias(S.HOST), "edges", "per")
    rows = _slotted(rows.join(F.broadcast(many), S.HOST, "left"), _micros(S.TS), "_slot").drop("edges", "per")
    rows = rows.withColumn("_slot", F.coalesce("_slot", F.lit(0).cast("long")))
    spans = subscription_spans(messages).withColumnRenamed(S.HOST, "_host").join(hosts, "_host")
    # ``end`` itself is out, and null while a subscription holds.
    spans = spans.withColumns({"_first": _micros("begin"), "_last": F.coalesce(_micros("end") - 1, F.col("high"))})
    spans = spans.where((F.col("_first") <= F.col("high")) & (F.col("_last") >= F.col("low")))
    spans = _slotted(spans, F.greatest("_first", "low"), "_from")
    spans = _slotted(spans, F.least("_last", "high"), "_to")
    return rows, spans.select(CLIENT, "_host", "begin", "end", F.explode(F.sequence("_from", "_to")).alias("_slot"))


def subscribed_rows(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """(client, row) of every row and each client subscribed to its host at its time.

    An equal join on the host and a slot of its time, with a range on the time: a
    span meets the rows of its first and last slots, and all rows of the others
    are delivered.
    """
    columns = rows.columns
    rows, spans = dealt(rows, messages)
    spans = spans.withColumnRenamed("_slot", "_in")
    at = (F.col(S.HOST) == F.col("_host")) & (F.col("_slot") == F.col("_in")) & (F.col(S.TS) >= F.col("begin")) & (F.col("end").isNull() | (F.col(S.TS) < F.col("end")))
    return rows.join(spans, at).select(CLIENT, *columns)


class SubscriptionFeed:
    """Delivers a stream's rows to the clients that are subscribed.

    Rows and messages come in one stream with the columns ``row`` and ``message``, either
    of them null (``merged_stream`` makes one of two). A micro-batch's
    messages are kept first, then its rows are joined as of their times with all
    messages so far, so a subscription takes effect from the micro-batch that
    brings it, for rows from its time on. Both tables have a version for each
    micro-batch; one that runs again adds nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        self.messages = VersionedTable(spark, f"{self.path}/messages", MESSAGE_SCHEMA, S.TS)
        self.delivered = VersionedTable(spark, f"{self.path}/delivered", DELIVERED_SCHEMA, S.TS)

    def start(self, merged: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        writer = f"feed-{zlib.crc32(self.path.encode()):08x}"

        def route(batch: DataFrame, number: int) -> None:
            self.messages.append(batch.where(F.col("message").isNotNull()).select("message.*"), writer, number)
            rows = batch.where(F.col("row").isNotNull()).select("row.*")
            self.delivered.append(subscribed_rows(rows, self.messages.scan().drop(self.messages.day)), writer, number)

        query = merged.writeStream.foreachBatch(route).option("checkpointLocation", f"{self.path}/checkpoint")
        return query.trigger(**(trigger or {"processingTime": "10 seconds"})).start()

    def rows(self) -> DataFrame:
        """(client, row) of everything delivered."""
        return self.delivered.scan().drop(self.delivered.day)


def fact() -> Column:
    """The fact columns of a row as one struct."""
    return F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.METRICS_SCHEMA.fields])


def message(client: Column, host: Column, at: Column, seq: Column, subscribe: Column) -> Column:
    """A subscription message as one struct."""
    return F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in zip((client, host, at, seq, subscribe), MESSAGE_SCHEMA.fields)])


def merged_stream(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """One stream of fact rows and of messages (the columns of MESSAGE_SCHEMA), each as a struct, the other one null."""
    none = lambda schema: F.lit(None).cast(schema)
    told = messages.select(none(S.METRICS_SCHEMA).alias("row"), message(*map(F.col, MESSAGE_SCHEMA.names)).alias("message"))
    return rows.select(fact().alias("row"), none(MESSAGE_SCHEMA).alias("message")).unionByName(told)
