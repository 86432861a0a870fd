"""Outages of a stream by keyed state: chunks of a host first, then their chain.

The first operator keeps the rows of each (host, time chunk) and, when the
watermark has passed the chunk's end, sums them up in one row: the outages inside
it, and what its ends mean for its neighbours. The second takes the chunks of each
host in order and joins the outages that cross them; it sees one row for each
chunk, however many probes a host has. A micro-batch appends its own rows to the
state and reads only the chunks that end with it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from linkwatch import schema as S
from linkwatch.session import ship_package
from linkwatch.streaming.jobs import DOWNTIME_OUT_SCHEMA, ROCKSDB_PROVIDER

#: Microseconds of a chunk, by its unit.
CHUNKS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}

#: A time that stands for none.
NONE = -(1 << 62)

_SUMMARY = T.StructType(
    [
        T.StructField(S.HOST, T.StringType(), True),
        T.StructField("chunk", T.LongType(), True),
        T.StructField("first_us", T.LongType(), True),
        T.StructField("first_loss", T.BooleanType(), True),
        # The first answered probe (or NONE) and the begin of the outage that is open at the end (or NONE).
        T.StructField("answer_us", T.LongType(), True),
        T.StructField("open_us", T.LongType(), True),
        T.StructField("starts", T.ArrayType(T.LongType()), True),
        T.StructField("ends", T.ArrayType(T.LongType()), True),
    ]
)


def _summarize():
    """``summarize(ts, ids, lost)``: a chunk's rows, in any order, as one tuple (without host and chunk)."""
    import numpy as np

    none = NONE

    def summarize(ts, ids, lost):
        order = np.lexsort((ids, ts))
        ts, lost = ts[order], lost[order]
        before = np.r_[False, lost[:-1]]
        begins, closes = ts[lost & ~before], ts[~lost & before]
        answered = ts[~lost]
        answer = int(answered[0]) if len(answered) else none
        if lost[0]:
            # What the first row is part of may have begun before.
            begins, closes = begins[1:], closes[1:]
        open_at = int(begins[-1]) if len(begins) > len(closes) else none
        if answer == none:
            open_at = int(ts[0])
        k = len(closes)
        return int(ts[0]), bool(lost[0]), answer, open_at, [int(x) for x in begins[:k]], [int(x) for x in closes]

    return summarize


def chunk_processor(chunk_us: int) -> StatefulProcessor:
    """Keyed by (host, chunk): rows in a list state, a timer at the chunk's end."""
    import numpy as np
    import pandas as pd

    summarize, names = _summarize(), list(_SUMMARY.names)
    ts_col, id_col, loss_col = S.TS, S.ID, S.LOSS

    class _Chunk(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.rows = handle.getListState("rows", "ts array<bigint>, ids array<bigint>, lost array<boolean>")

        def handleInputRows(self, key, rows, timerValues):
            known = self.rows.exists()
            for pdf in rows:
                # One state entry for each batch of rows.
                ts, ids, lost = (pdf[c].tolist() for c in (ts_col, id_col, loss_col))
                self.rows.appendValue(([int(x) for x in ts], [int(x) for x in ids], [bool(x) for x in lost]))
            if not known:
                self.handle.registerTimer((int(key[1]) + 1) * chunk_us // 1000)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            parts = list(self.rows.get())
            ts, ids = (np.concatenate([np.asarray(p[k], dtype="int64") for p in parts]) for k in (0, 1))
            lost = np.concatenate([np.asarray(p[2], dtype=bool) for p in parts])
            self.rows.clear()
            yield pd.DataFrame([(key[0], int(key[1]), *summarize(ts, ids, lost))], columns=names)

        def close(self) -> None:
            pass

    return _Chunk()


def _chain():
    """``chain(open_us, summary)``: the outages that a chunk closes, and what is open after it (or NONE)."""
    none = NONE

    def chain(open_us, first_us, first_loss, answer, chunk_open, starts, ends):
        begin = open_us if open_us != none else first_us if first_loss else none
        if answer == none:  # lost throughout
            return [], begin
        out = [(begin, answer)] if begin != none else []
        return out + list(zip(starts, ends)), chunk_open

    return chain


def chain_processor(min_duration_seconds: float) -> StatefulProcessor:
    """Keyed by host: where its open outage began."""
    import pandas as pd

    chain, none, names, least = _chain(), NONE, list(DOWNTIME_OUT_SCHEMA.names), float(min_duration_seconds)

    class _Chain(StatefulProcessor):
        def init(self, handle) -> None:
            self.open = handle.getValueState("open", "open_us bigint")

        def handleInputRows(self, key, rows, timerValues):
            at = int(self.open.get()[0]) if self.open.exists() else none
            found = []
            chunks = pd.concat(list(rows), ignore_index=True).sort_values("chunk")
            for r in chunks.itertuples(index=False):
                closed, at = chain(at, int(r.first_us), bool(r.first_loss), int(r.answer_us), int(r.open_us), [int(x) for x in r.starts], [int(x) for x in r.ends])
                found += closed
            self.open.update((at,))
            kept = [(key[0], s, e, (e - s) / 1e6) for s, e in found if (e - s) / 1e6 >= least]
            out = pd.DataFrame(kept, columns=names)
            for c in names[1:3]:
                out[c] = pd.to_datetime(out[c].astype("int64"), unit="us")
            yield out

        def close(self) -> None:
            pass

    return _Chain()


def stream_outages(src: DataFrame, min_duration_seconds: float = 30, lateness: str = "1 hour", chunk_unit: str = "hour") -> DataFrame:
    """Outages of a stream, each given out once the chunk in which it ends is complete (append mode).

    Rows may come in any order within ``lateness``; later ones are dropped by the
    watermark. Null flags count as not lost, as at ingest; rows without a host
    only move the watermark on. The state needs the RocksDB provider.
    """
    spark = src.sparkSession
    ship_package(spark)
    if ROCKSDB_PROVIDER not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        raise ValueError(f"keyed outages need spark.sql.streaming.stateStore.providerClass={ROCKSDB_PROVIDER}")
    us = F.unix_micros(S.TS)
    rows = src.withWatermark(S.TS, lateness).select(
        S.HOST, S.TS, us.alias("_us"), F.floor(us / CHUNKS[chunk_unit]).cast("long").alias("_chunk"), F.coalesce(S.ID, F.lit(0).cast("long")).alias(S.ID), F.coalesce(S.LOSS, F.lit(False)).alias(S.LOSS)
    )
    rows = rows.select(S.HOST, "_chunk", F.col(S.TS).alias("_time"), F.col("_us").alias(S.TS), S.ID, S.LOSS)
    chunks = rows.groupBy(S.HOST, "_chunk").transformWithStateInPandas(chunk_processor(CHUNKS[chunk_unit]), _SUMMARY, "Append", "EventTime")
    chunks = chunks.where(F.col(S.HOST).isNotNull())
    return chunks.groupBy(S.HOST).transformWithStateInPandas(chain_processor(min_duration_seconds), DOWNTIME_OUT_SCHEMA, "Append", "None")


def closing_row(spark: SparkSession, at: datetime, schema: T.StructType) -> DataFrame:
    """A row without a host that ends a finite feed: at ``at``, later than all others by the lateness and a chunk."""
    values = {S.ID: 0, S.TS: at, S.LOSS: False, S.CREATED: at}
    return spark.createDataFrame([Row(**{f.name: values.get(f.name) for f in schema.fields})], schema)
