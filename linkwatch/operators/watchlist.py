"""Watchlist (the set of monitored hosts) and live-feed message routing."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwatch import schema as S
from linkwatch.functions.present import host_input
from linkwatch.functions.timefns import iso_text
from linkwatch.operators.latest import shard_count


def watchlist(spark: SparkSession, hosts: Iterable[str] = S.DEFAULT_HOSTS) -> DataFrame:
    """A one-column ``target_host`` DataFrame from a driver-side list."""
    from linkwatch.operators.stats import host_list

    return host_list(spark, hosts)


def watchlist_add(wl: DataFrame, hosts: DataFrame | Iterable[str]) -> DataFrame:
    """Add hosts that are not yet watched (input trimmed, empty ignored)."""
    new = hosts if isinstance(hosts, DataFrame) else watchlist(wl.sparkSession, hosts)
    new = new.select(host_input(S.HOST).alias(S.HOST)).where(F.col(S.HOST) != F.lit(""))
    return wl.select(S.HOST).unionByName(new).distinct()


def watchlist_remove(wl: DataFrame, hosts: DataFrame | Iterable[str]) -> DataFrame:
    """Remove hosts from the watchlist (anti join). Their latest results go with
    them: see ``forget_hosts``."""
    gone = hosts if isinstance(hosts, DataFrame) else watchlist(wl.sparkSession, hosts)
    return wl.join(gone.select(S.HOST), on=S.HOST, how="left_anti")


def forget_hosts(latest: DataFrame, hosts: DataFrame | Iterable[str]) -> DataFrame:
    """Latest-result rows without those of removed hosts (anti join)."""
    gone = hosts if isinstance(hosts, DataFrame) else watchlist(latest.sparkSession, hosts)
    return latest.join(gone.select(S.HOST), on=S.HOST, how="left_anti")


def host_inventory(pm: DataFrame, wl: DataFrame) -> DataFrame:
    """Stored hosts and watched hosts side by side: ``target_host,
    in_database, in_watchlist`` (full outer join of the two host sets)."""
    stored = pm.select(S.HOST).distinct().select(S.HOST, F.lit(True).alias("in_database"))
    watched = wl.select(S.HOST).distinct().select(S.HOST, F.lit(True).alias("in_watchlist"))
    j = stored.join(watched, on=S.HOST, how="full_outer")
    return j.select(
        S.HOST,
        F.coalesce("in_database", F.lit(False)).alias("in_database"),
        F.coalesce("in_watchlist", F.lit(False)).alias("in_watchlist"),
    )


def probe_results(pm: DataFrame) -> DataFrame:
    """Fact rows as prober results: ``host, response_time_ms, packet_loss,
    error_message, timestamp`` (ISO text)."""
    return pm.select(
        F.col(S.HOST).alias("host"), S.RT, S.LOSS, S.ERR, iso_text(S.TS).alias(S.TS), F.col(S.TS).alias("_ts")
    )


def probe_cycles(pm: DataFrame, interval: str = "10 seconds", shards: int | None = None) -> DataFrame:
    """Group probes into cycles (tumbling windows): ``cycle_start, part, has_dns,
    type, timestamp, results array<probe>``.

    A cycle's message comes in parts by a hash of the host; ``has_dns`` tells of
    the whole cycle. Without ``shards`` the parts follow the number of hosts
    (``shard_count``, a job as the plan is built), so an array holds the results of
    about HOSTS_TOGETHER hosts.
    """
    shards = shard_count(pm) if shards is None else shards
    res = probe_results(pm).withColumn("_w", F.window("_ts", interval))
    is_dns = F.col("host").isin(*S.DNS_HOSTS)
    cycles = res.groupBy(F.col("_w").alias("_c")).agg(F.max(is_dns).alias("has_dns"))
    part = F.pmod(F.xxhash64("host"), F.lit(int(shards))).cast("int")
    cyc = res.groupBy("_w", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("_ts", "host", S.RT, S.LOSS, S.ERR, S.TS))).alias("_r")
    )
    cyc = cyc.join(cycles, F.col("_w") == F.col("_c"))
    results = F.transform(
        "_r", lambda r: F.struct(r["host"].alias("host"), r[S.RT].alias(S.RT), r[S.LOSS].alias(S.LOSS),
                                 r[S.ERR].alias(S.ERR), r[S.TS].alias(S.TS))
    )
    return cyc.select(
        F.col("_w.start").alias("cycle_start"),
        "part",
        "has_dns",
        F.lit(S.MSG_PING_UPDATE).alias("type"),
        iso_text(F.col("_w.end")).alias(S.TS),
        results.alias("results"),
    )


def route_updates(cycles: DataFrame) -> DataFrame:
    """Routing of cycle messages: a cycle with any DNS host result becomes a
    ``dns_status_update`` carrying only the DNS results; others stay as they are.
    Adds ``route`` (``dns`` / ``all``); parts left without results go."""
    dns = F.array(*[F.lit(h) for h in S.DNS_HOSTS])
    dns_results = F.filter("results", lambda r: F.array_contains(dns, r["host"]))
    has_dns = F.col("has_dns")
    out = cycles.select(
        *[c for c in cycles.columns if c not in ("type", "results", "has_dns")],
        F.when(has_dns, F.lit(S.MSG_DNS_UPDATE)).otherwise(F.col("type")).alias("type"),
        F.when(has_dns, dns_results).otherwise(F.col("results")).alias("results"),
        F.when(has_dns, F.lit("dns")).otherwise(F.lit("all")).alias("route"),
    )
    return out.where(F.size("results") > 0)


def route_results(results: DataFrame) -> DataFrame:
    """Routing of single results (one message each): that of a DNS host becomes a
    ``dns_status_update`` on route ``dns``, others are a ``ping_result`` on ``all``."""
    is_dns = F.col("host").isin(*S.DNS_HOSTS)
    return results.select(
        *[c for c in results.columns if c != "_ts"],
        F.when(is_dns, F.lit(S.MSG_DNS_UPDATE)).otherwise(F.lit(S.MSG_PING_RESULT)).alias("type"),
        F.when(is_dns, F.lit("dns")).otherwise(F.lit("all")).alias("route"),
    )


def emit_json(cycles: DataFrame) -> DataFrame:
    """One JSON message per cycle: ``{"type", "timestamp", "results": [...]}``
    in column ``value`` (ready for a text/Kafka sink)."""
    return cycles.select(F.to_json(F.struct("type", S.TS, "results")).alias("value"))
