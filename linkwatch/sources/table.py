"""The probe fact table as a versioned table: ids, bloom filters, clustering.

Appended rows without an id get consecutive ones; the range is reserved in the
log before the rows are written, so batch and stream writers never share an id
and a micro-batch that runs again takes the same ones. Files carry a bloom
filter on ``id``, so a lookup reads the row groups that may hold it. Compacted
files follow a space-filling curve over host, time and response time, so
predicates on any of the three skip files.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkwatch import schema as S
from linkwatch.sources.ingest import assign_ids
from linkwatch.sources.versions import State, VersionedTable

#: Bits of each dimension of the curve.
CURVE_BITS = 8
#: Hosts, the first by hash, whose order ranks all of them.
HOST_SAMPLE = 4096


def _rank(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are not above the value, by halving, spread over all of a dimension's numbers; 0 for null."""
    if not bounds:
        return F.lit(0)
    parts = 1 << CURVE_BITS
    known = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= value, at + step).otherwise(at))
    return F.floor(below * parts / (len(bounds) + 1))


def interleaved(*ranks: Column) -> Column:
    """The bits of the ranks in turn, the highest first: near rows in every dimension get near numbers."""
    n = len(ranks)
    out = F.lit(0).cast("long")
    for bit in range(CURVE_BITS):
        for k, r in enumerate(ranks):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(r.cast("long"), bit).bitwiseAND(F.lit(1)), bit * n + (n - 1 - k)))
    return out


def curve_bounds(rows: DataFrame) -> tuple[list[str], list[float]]:
    """Bounds that cut the hosts and the response times into at most 2 ** CURVE_BITS parts of equal size."""
    parts = 1 << CURVE_BITS
    hosts = rows.select(S.HOST).distinct().orderBy(F.xxhash64(S.HOST), S.HOST).limit(HOST_SAMPLE)
    names = sorted(r[0] for r in hosts.collect())  # at most HOST_SAMPLE
    names = names[1:] if len(names) <= parts else [names[(len(names) * k) // parts] for k in range(1, parts)]
    shares = [k / parts for k in range(1, parts)]
    times = rows.agg(F.percentile_approx(S.RT, shares, 10_000)).first()[0] or []  # at most 2 ** CURVE_BITS
    return names, sorted(set(times))


def along_curve(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_z``, each row's place on the curve through its date."""
    hosts, times = curve_bounds(rows)
    second = F.timestamp_diff("SECOND", F.to_date(S.TS).cast("timestamp_ntz"), F.col(S.TS))
    ranks = {"_z0": _rank(F.col(S.HOST), hosts), "_z1": F.floor(second * (1 << CURVE_BITS) / 86_400), "_z2": _rank(F.col(S.RT), times)}
    return rows.withColumns(ranks).withColumn("_z", interleaved(*map(F.col, ranks))).drop(*ranks)


class MetricTable(VersionedTable):
    """The fact table at ``path``; ``scan``, ``compact``, ``retain`` and ``vacuum`` are those of every versioned table."""

    day = S.METRIC_DATE

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path, S.METRICS_SCHEMA, S.TS)

    def options(self) -> dict[str, str]:
        return {
            f"parquet.bloom.filter.enabled#{S.ID}": "true",
            "parquet.bloom.filter.adaptive.enabled": "true",
            # The curve's order repeats hosts, not ids: a dictionary of ids only takes room.
            f"parquet.enable.dictionary#{S.ID}": "false",
        }

    def layout(self, rows: DataFrame, files: int | None) -> DataFrame:
        """A write of unknown size by host and time; one of ``files`` files along the curve."""
        if files is None:
            return rows.hint("rebalance", self.day).sortWithinPartitions(self.day, S.HOST, S.TS, S.ID)
        return along_curve(rows).repartitionByRange(files, self.day, "_z", S.TS).sortWithinPartitions(self.day, "_z", S.TS, S.ID).drop("_z")

    def append(self, rows: DataFrame, writer: str | None = None, batch: int = 0) -> State:
        """Add fact rows as one version; rows without an id get the next ones, in time order.

        A batch that ``writer`` has added already adds nothing. Columns that are
        missing are null, ``created_at`` is the row's time.
        """
        if writer and self.state().done.get(writer, -1) >= batch:
            return self.state()
        rows = self._whole(rows).persist(StorageLevel.DISK_ONLY)
        try:
            # Two numbers.
            lacking, most = rows.agg(F.count_if(F.col(S.ID).isNull()), F.max(S.ID)).first()
            if lacking:
                start = self._reserve(writer, batch, lacking, (most or 0) + 1)
                numbered = assign_ids(rows.where(F.col(S.ID).isNull()), start)
                rows_with_id = numbered.unionByName(rows.where(F.col(S.ID).isNotNull()))
            else:
                rows_with_id = rows
                if most is not None:
                    self.commit(lambda s: {"operation": "reserve", "next_id": most + 1} if s.next_id <= most else None)
            added = self.write(rows_with_id, f"{writer}-{batch}" if writer else uuid.uuid4().hex)
        finally:
            rows.unpersist()
        return self._publish_append(added, writer, batch)

    def _whole(self, rows: DataFrame) -> DataFrame:
        missing = {f.name: F.lit(None).cast(f.dataType) for f in self.schema.fields if f.name not in rows.columns}
        rows = rows.withColumns(missing) if missing else rows
        rows = rows.withColumn(S.CREATED, F.coalesce(F.col(S.CREATED), F.col(S.TS)))
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def _reserve(self, writer: str | None, batch: int, n: int, least: int) -> int:
        """The first of ``n`` ids that are this batch's; the same again if it was tried before with as many rows."""

        def change(state: State) -> dict | None:
            held = state.reserved.get(writer or "")
            if writer and held and held[0] == batch and held[2] == n and held[1] >= least:
                return None
            start = max(state.next_id, least)
            return {"operation": "reserve", "next_id": start + n, "reserved": {writer: [batch, start, n]} if writer else {}, "start": start}

        state = self.commit(change)
        return state.reserved[writer][1] if writer else state.next_id - n

    def by_id(self, metric_id: int) -> DataFrame:
        """The row of an id (at most one): the bloom filters leave out row groups without it."""
        return self.scan().where(F.col(S.ID) == F.lit(metric_id)).select(*S.METRIC_COLUMNS).limit(1)


def stream_into(rows: DataFrame, table: MetricTable, checkpoint: str, trigger: dict | None = None, compact_every: int = 0) -> StreamingQuery:
    """Append a stream of fact rows, one version for each micro-batch; a micro-batch that runs again adds nothing.

    With ``compact_every``, small folders are rewritten after so many micro-batches.
    """
    writer = f"stream-{zlib.crc32(checkpoint.encode()):08x}"

    def sink(batch: DataFrame, number: int) -> None:
        table.append(batch, writer, number)
        if compact_every and number % compact_every == compact_every - 1:
            table.compact()

    query = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
