"""SQL surface: the fact table as a view plus SQL table functions.

``avg_response_time_by_hour(host_filter, as_of)`` is a SQL table function
(``CREATE TEMPORARY FUNCTION ... RETURNS TABLE``) over the view, so SQL
users get the same plan as the DataFrame operator. Hour buckets are NTZ
arithmetic and "now" is UTC wall clock, as in the DataFrame operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_table_functions(spark: SparkSession, pm: DataFrame, view: str = "ping_metrics") -> None:
    """Register ``pm`` as ``view`` and the table functions that read it."""
    pm.createOrReplaceTempView(view)
    spark.sql(
        f"""
CREATE OR REPLACE TEMPORARY FUNCTION avg_response_time_by_hour(
    host_filter STRING DEFAULT NULL,
    as_of TIMESTAMP_NTZ DEFAULT NULL)
RETURNS TABLE (
    hour_bucket TIMESTAMP_NTZ,
    target_host STRING,
    avg_response_time DOUBLE,
    packet_count BIGINT,
    packet_loss_rate DOUBLE)
RETURN
  SELECT timestampadd(MICROSECOND,
             -pmod(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', pm.`timestamp`), 3600000000L),
             pm.`timestamp`) AS hour_bucket,
         pm.target_host,
         AVG(pm.response_time_ms) AS avg_response_time,
         COUNT(*) AS packet_count,
         try_divide(CAST(count_if(pm.packet_loss = TRUE) AS DOUBLE), COUNT(*)) * 100 AS packet_loss_rate
  FROM {view} pm
  WHERE (host_filter IS NULL OR host_filter = '' OR pm.target_host = host_filter)
    AND pm.`timestamp` >= COALESCE(as_of, convert_timezone('UTC', localtimestamp())) - INTERVAL 7 DAYS
  GROUP BY 1, 2
"""
    )
