"""Cycle messages on streams: results are gathered into cycles, routed as a whole and written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkwatch import schema as S
from linkwatch.functions.timefns import iso_text
from linkwatch.operators.watchlist import route_updates


def stream_cycles(src: DataFrame, interval: str = "10 seconds", lateness: str = "1 minute", parts: int = 32) -> DataFrame:
    """Probe cycles as ``probe_cycles`` gives them, from a stream, once the watermark has passed their end.

    Two stateful operators in a row: results are gathered by (cycle, part), a part
    being the hosts of one hash value, and joined with what is known of the whole
    cycle (whether a DNS host is in it), which is summed on its own. Rows that
    come after their cycle was given out are dropped by the watermark. An array
    holds about ``hosts / parts`` results.
    """
    rows = src.withWatermark(S.TS, lateness).withColumn("_c", F.window(S.TS, interval))
    result = F.struct(
        F.col(S.TS).alias("_ts"), F.col(S.HOST).alias("host"), F.col(S.RT).alias(S.RT), F.col(S.LOSS).alias(S.LOSS), F.col(S.ERR).alias(S.ERR), iso_text(S.TS).alias(S.TS)
    )
    part = F.pmod(F.xxhash64(S.HOST), F.lit(int(parts))).cast("int")
    gathered = rows.groupBy("_c", part.alias("part")).agg(F.sort_array(F.collect_list(result)).alias("_r"))
    whole = rows.groupBy(F.col("_c").alias("_w")).agg(F.max(F.col(S.HOST).isin(*S.DNS_HOSTS)).alias("has_dns"))
    cycles = gathered.join(whole, F.col("_c") == F.col("_w"))
    results = F.transform("_r", lambda r: F.struct(*[r[c].alias(c) for c in ("host", S.RT, S.LOSS, S.ERR, S.TS)]))
    return cycles.select(
        F.col("_c.start").alias("cycle_start"), "part", "has_dns", F.lit(S.MSG_PING_UPDATE).alias("type"), iso_text(F.col("_c.end")).alias(S.TS), results.alias("results")
    )


def stream_messages(src: DataFrame, path: str, checkpoint: str, interval: str = "10 seconds", lateness: str = "1 minute", parts: int = 32, trigger: dict | None = None) -> StreamingQuery:
    """Write each cycle's messages as JSON lines under ``path``, in a folder for each route.

    A cycle with a result of a DNS host becomes one DNS message without the other
    results (``route_updates``). The file sink writes every message once, also
    after a restart.
    """
    routed = route_updates(stream_cycles(src, interval, lateness, parts))
    messages = routed.select(F.to_json(F.struct("type", S.TS, "results")).alias("value"), "route")
    sink = messages.writeStream.format("text").partitionBy("route").option("path", path).option("checkpointLocation", checkpoint)
    return sink.outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start()


