"""Small stream inputs for the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwatch import schema as S
from linkwatch.functions.timefns import ts_literal


def stage_files(df: DataFrame, path: str, n_files: int = 4, time_col: str = S.TS, first_part: int = 0) -> str:
    """Write ``df`` as ``n_files`` Parquet files covering consecutive time ranges, one
    after another, so that the file source replays them in event-time order."""
    b = df.agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi")).first()
    step = (b["hi"] - b["lo"]) / n_files
    for i in range(n_files):
        cond = F.col(time_col) >= ts_literal(b["lo"] + step * i) if i else F.lit(True)
        if i < n_files - 1:
            cond = cond & (F.col(time_col) < ts_literal(b["lo"] + step * (i + 1)))
        df.where(cond).coalesce(1).write.mode("overwrite").parquet(f"{path}/part={first_part + i}")
    return path


def stage_batches(spark, batches: list[list[tuple]], path: str, first_part: int = 0) -> str:
    """One file for each list of fact rows, in this order."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, S.METRICS_SCHEMA)
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/part={first_part + i}")
    return path
