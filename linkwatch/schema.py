"""Schemas, column names and fixed values of the probe fact table.

Every operator in the package reads and writes the ``ping_metrics`` layout
below: one row per probe of one host.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import types as T

# --- column names ------------------------------------------------------------
ID = "id"
TS = "timestamp"
HOST = "target_host"
RT = "response_time_ms"
LOSS = "packet_loss"
ERR = "error_message"
CREATED = "created_at"
METRIC_DATE = "metric_date"

METRIC_COLUMNS = (ID, TS, HOST, RT, LOSS, ERR, CREATED)

# --- fixed values (must equal the monitored service's behaviour) ---------------
# Default watchlist, in its original order.
DEFAULT_HOSTS = ("8.8.8.8", "1.1.1.1", "208.67.222.222", "google.com", "github.com")
# Hosts whose results are routed to the DNS status feed.
DNS_HOSTS = ("8.8.8.8", "1.1.1.1", "208.67.222.222")
# Error text stored for a probe that got no reply.
LOSS_MESSAGE = "Ping timeout or host unreachable"
# Placeholder for missing provider fields.
UNKNOWN = "Unknown"
# Dashboard range presets, in minutes.
RANGE_PRESETS = {"1hr": 60, "1d": 1440, "1w": 10080}
# Reliability tiers on uptime percent: (lower bound inclusive, status, colour tier).
RELIABILITY_TIERS = (
    (99.5, "Excellent", "primary"),
    (99.0, "Good", "secondary"),
    (95.0, "Fair", "muted"),
)
RELIABILITY_FLOOR = ("Poor", "muted")
# Message types of the live feed.
MSG_PING_RESULT = "ping_result"
MSG_PING_UPDATE = "ping_update"
MSG_DNS_UPDATE = "dns_status_update"
# Sample rows shipped with the table definition: host, response time.
SEED_ROWS = (("8.8.8.8", 15.2), ("1.1.1.1", 12.8), ("google.com", 18.5))
RT_DECIMALS = 2

# "now" of the fixture tables (the batch operators never read the clock).
FIXTURE_AS_OF = datetime(2024, 1, 31, 0, 0, 0)

# --- schemas -----------------------------------------------------------------
METRICS_SCHEMA = T.StructType(
    [
        T.StructField(ID, T.LongType(), False),
        T.StructField(TS, T.TimestampNTZType(), False),
        T.StructField(HOST, T.StringType(), False),
        T.StructField(RT, T.DoubleType(), True),
        T.StructField(LOSS, T.BooleanType(), True),
        T.StructField(ERR, T.StringType(), True),
        T.StructField(CREATED, T.TimestampNTZType(), False),
    ]
)

# Result of one probe as produced by the prober (timestamp is ISO-8601 text).
RAW_PROBE_SCHEMA = T.StructType(
    [
        T.StructField("host", T.StringType(), False),
        T.StructField(RT, T.DoubleType(), True),
        T.StructField(LOSS, T.BooleanType(), True),
        T.StructField(ERR, T.StringType(), True),
        T.StructField(TS, T.StringType(), True),
    ]
)

# JSON body of a manual insert request.
CREATE_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField(HOST, T.StringType(), True),
        T.StructField(RT, T.DoubleType(), True),
        T.StructField(LOSS, T.BooleanType(), True),
        T.StructField(ERR, T.StringType(), True),
    ]
)

# Provider lookup record.
PROVIDER_JSON_SCHEMA = T.StructType(
    [T.StructField(k, T.StringType(), True) for k in ("ip", "hostname", "city", "region", "country", "org")]
)
