"""Keyed state as a table: changed keys are appended, the newest row of a key counts, and folding drops the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwatch import schema as S
from linkwatch.operators.latest import latest_rows
from linkwatch.sources.versions import State, VersionedTable

#: Which put a row came with.
PUT = "put"


class KeyedStore(VersionedTable):
    """The newest row of each of ``keys``.

    A put writes the changed keys only. ``order`` says which row of a key is the
    newest (the later put without it, and among equals), so puts may come in any
    order of time. ``fold`` rewrites the store as one row a key; readers of the
    version before keep theirs.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, time: str, keys: Sequence[str], order: Sequence[str] = ()) -> None:
        super().__init__(spark, path, T.StructType([*schema.fields, T.StructField(PUT, T.LongType(), False)]), time)
        self.keys, self.order = list(keys), [*order, PUT]

    def put(self, rows: DataFrame, writer: str, batch: int) -> State:
        """Add the rows of changed keys; the same batch again adds nothing."""
        return self.append(rows.withColumn(PUT, F.lit(batch).cast("long")), writer, batch)

    def _newest(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order])
        return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

    def current(self, version: int | None = None) -> DataFrame:
        """One row a key."""
        return self._newest(self.scan(version=version)).drop(PUT, self.day)

    def fold(self) -> int:
        """Rewrite the store as one row a key; the number of folders replaced."""
        old = list(self.state().folders.values())
        if len(old) < 2:
            return 0
        return len(old) if self.replace(old, self._newest(self.read(old)), "fold") else 0


def latest_store(spark: SparkSession, path: str) -> KeyedStore:
    """The latest row of each host."""
    return KeyedStore(spark, path, S.METRICS_SCHEMA, S.TS, [S.HOST], [S.TS, S.ID])


def put_latest(store: KeyedStore, batch: DataFrame, writer: str, number: int) -> State:
    """Put the latest row of each host that a micro-batch has rows of."""
    return store.put(latest_rows(batch.select(*S.METRICS_SCHEMA.names)), writer, number)
