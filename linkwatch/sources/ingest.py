"""Ingest: raw probe results and JSON messages -> fact rows.

Everything here is column expressions (``from_json``, ``when``, ``round``),
so ingest runs fully inside whole-stage codegen on the executors.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwatch import schema as S
from linkwatch.functions.present import location_label, or_placeholder
from linkwatch.functions.timefns import bucket, ts_literal


def normalize_probe(raw: DataFrame) -> DataFrame:
    """Prober result -> metric row fields.

    * no response time and an error text: loss with that text (the prober
      raised an exception);
    * no response time otherwise: loss with the fixed timeout text;
    * a response time: rounded to 2 decimals, no loss, no error text.

    Input columns: ``host, response_time_ms, packet_loss, error_message,
    timestamp`` (ISO text or timestamp). Output: ``target_host,
    response_time_ms, packet_loss, error_message, timestamp`` (NTZ).
    """
    rt = F.col(S.RT)
    no_reply = rt.isNull()
    err = F.when(no_reply, F.coalesce(F.col(S.ERR), F.lit(S.LOSS_MESSAGE)))
    ts = F.col(S.TS)
    ts = F.to_timestamp_ntz(ts) if dict(raw.dtypes).get(S.TS) == "string" else ts.cast("timestamp_ntz")
    extra = [c for c in raw.columns if c not in ("host", S.RT, S.LOSS, S.ERR, S.TS)]
    return raw.select(
        *extra,
        F.col("host").alias(S.HOST),
        F.when(no_reply, F.lit(None).cast("double")).otherwise(F.round(rt, S.RT_DECIMALS)).alias(S.RT),
        no_reply.alias(S.LOSS),
        err.alias(S.ERR),
        ts.alias(S.TS),
    )


def apply_defaults(df: DataFrame, now: datetime) -> DataFrame:
    """Column defaults of the fact table: ``timestamp``/``created_at`` = now,
    ``packet_loss`` = FALSE (also turns a NULL flag into FALSE)."""
    now_lit = ts_literal(now)
    cols = df.columns
    out = df
    out = out.withColumn(S.TS, F.coalesce(F.col(S.TS), now_lit) if S.TS in cols else now_lit)
    out = out.withColumn(S.CREATED, F.coalesce(F.col(S.CREATED), now_lit) if S.CREATED in cols else now_lit)
    out = out.withColumn(S.LOSS, F.coalesce(F.col(S.LOSS), F.lit(False)) if S.LOSS in cols else F.lit(False))
    for c, t in ((S.RT, "double"), (S.ERR, "string")):
        if c not in cols:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out


def assign_ids(df: DataFrame, start: int = 1, chunk_unit: str = "minute") -> DataFrame:
    """Consecutive ids ``start, start+1, ...`` in ``(timestamp, target_host)`` order.

    Numbered like the outage ordinals: a local ``row_number`` per time chunk
    plus the row count of all earlier chunks (a summary with one row per
    chunk, bounded by time span / chunk width, summed per day and then across
    days), so no single task sorts the whole input. A chunk holds every host's rows of that time slice, hence
    the fine default (one minute); ``second`` suits very high probe rates.
    """
    chunk = bucket(S.TS, chunk_unit).alias("_chunk")
    base = df.select("*", chunk)
    w = Window.partitionBy("_chunk").orderBy(S.TS, S.HOST)
    local = base.select("*", F.row_number().over(w).cast("long").alias("_local"))
    counts = base.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n")).select(
        "_chunk", "_n", F.to_date("_chunk").alias("_day")
    )
    # Two-level prefix sums keep every window small: rows of earlier days
    # (one row per day in the only unpartitioned window), plus rows of
    # earlier chunks of the same day (window per day).
    per_day = counts.groupBy("_day").agg(F.sum("_n").alias("_dn"))
    days_before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    day_off = per_day.select("_day", F.coalesce(F.sum("_dn").over(days_before), F.lit(0)).alias("_doff"))
    in_day_before = Window.partitionBy("_day").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = (
        counts.select("_chunk", "_day", F.coalesce(F.sum("_n").over(in_day_before), F.lit(0)).alias("_coff"))
        .join(day_off, on="_day", how="inner")
        .select("_chunk", (F.col("_doff") + F.col("_coff")).cast("long").alias("_off"))
    )
    out = local.join(offs, on="_chunk", how="inner")
    keep = [c for c in df.columns if c != S.ID]
    return out.select((F.lit(int(start)) + F.col("_off") + F.col("_local") - F.lit(1)).cast("long").alias(S.ID), *keep)


def parse_probe_json(df: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Decode JSON insert requests; returns ``(valid, rejects)``.

    Each line is a JSON object with a string ``target_host``; ``packet_loss``, if
    there, is a boolean, ``response_time_ms`` a number or null, ``error_message``
    a string or null. A line that breaks a rule is rejected with the first reason
    that holds. Valid rows get the request defaults (``packet_loss`` FALSE).
    """
    v = F.try_parse_json(F.col(col))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    parsed = df.select("*", v.alias("_v"))
    host, loss, rt, err = (kind(f"$.{c}") for c in (S.HOST, S.LOSS, S.RT, S.ERR))
    number = rt.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") | rt.isin("VOID")
    reason = (
        F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), F.lit("Invalid JSON format"))
        .when(host.isNull(), F.lit("target_host required"))
        .when(host != "STRING", F.lit("target_host must be a string"))
        .when(loss != "BOOLEAN", F.lit("packet_loss must be a boolean"))
        .when(~number, F.lit("response_time_ms must be a number"))
        .when(~err.isin("STRING", "VOID"), F.lit("error_message must be a string"))
    )
    tagged = parsed.select("*", reason.alias("reject_reason"))
    get = lambda c, t: F.try_variant_get("_v", f"$.{c}", t)
    valid = tagged.where(F.col("reject_reason").isNull()).select(
        *df.columns,
        get(S.HOST, "string").alias(S.HOST),
        get(S.RT, "double").alias(S.RT),
        F.coalesce(get(S.LOSS, "boolean"), F.lit(False)).alias(S.LOSS),
        get(S.ERR, "string").alias(S.ERR),
    )
    rejects = tagged.where(F.col("reject_reason").isNotNull()).select(*df.columns, "reject_reason")
    return valid, rejects


def provider_info(df: DataFrame, col: str) -> DataFrame:
    """Provider fields from a JSON column: ``ip, hostname, city, region,
    country, provider`` (from ``org``); a missing field is ``Unknown``.
    Adds ``location`` = "city, country" or "--"."""
    j = F.from_json(F.col(col), S.PROVIDER_JSON_SCHEMA)
    fields = ("ip", "hostname", "city", "region", "country")
    out = df.select(
        "*",
        *[or_placeholder(j[f], S.UNKNOWN).alias(f) for f in fields],
        or_placeholder(j["org"], S.UNKNOWN).alias("provider"),
        location_label(j["city"], j["country"]).alias("location"),
    )
    return out


def raw_probes_from_metrics(pm: DataFrame) -> DataFrame:
    """Rebuild prober results from fact rows (for ingest round trips)."""
    from linkwatch.functions.timefns import iso_text

    return pm.select(
        F.col(S.ID).alias("probe_id"),
        F.col(S.HOST).alias("host"),
        S.RT,
        S.LOSS,
        F.lit(None).cast("string").alias(S.ERR),
        iso_text(S.TS).alias(S.TS),
    )


def ingest_probes(raw: DataFrame, now: datetime | None = None) -> DataFrame:
    """Raw results -> fact rows without ids (normalise, defaults; event time
    kept as ``timestamp``, ingest time ``now`` as ``created_at``)."""
    norm = normalize_probe(raw)
    if now is not None:
        norm = norm.withColumn(S.CREATED, ts_literal(now))
    return apply_defaults(norm, now or datetime(1970, 1, 1))

