"""Storage round trips: append, scan, retention, ingest, JSON parsing."""

from __future__ import annotations

from datetime import datetime, timedelta

from conftest import AS_OF, SF_SMALL
from linkwatch import schema as S
from linkwatch.sources import ingest as I
from linkwatch.sources.metrics import append_metrics, apply_retention, load_pm, scan_metrics


def test_append_scan_roundtrip(spark, tmp_path):
    path = str(tmp_path / "t")
    pm = load_pm(spark, SF_SMALL)
    append_metrics(pm, path)
    back = scan_metrics(spark, path).drop(S.METRIC_DATE)
    assert back.exceptAll(pm).count() == 0 and pm.exceptAll(back).count() == 0
    append_metrics(pm.limit(10), path)  # append mode adds rows
    assert scan_metrics(spark, path).count() == pm.count() + 10


def test_apply_retention(spark, tmp_path):
    path = str(tmp_path / "r")
    pm = load_pm(spark, SF_SMALL)
    append_metrics(pm, path)
    cutoff = AS_OF - timedelta(days=10)
    want_deleted = pm.where(pm[S.TS] < cutoff).count()
    assert apply_retention(spark, path, AS_OF, days=10) == want_deleted
    left = scan_metrics(spark, path)
    assert left.count() == pm.count() - want_deleted
    assert left.where(left[S.TS] < cutoff).count() == 0
    assert apply_retention(spark, path, AS_OF, days=10) == 0


def test_ingest_normalise_defaults_ids(spark):
    raw = spark.createDataFrame(
        [
            ("a", 12.345, False, None, "2024-01-02T03:04:05.123456"),
            ("a", None, True, None, "2024-01-02T03:04:06.000000"),
            ("b", None, True, "boom", "2024-01-02T03:04:05.000000"),
        ],
        S.RAW_PROBE_SCHEMA,
    )
    now = datetime(2024, 2, 1)
    rows = I.assign_ids(I.ingest_probes(raw, now=now), start=41).orderBy(S.ID).collect()
    assert [r[S.ID] for r in rows] == [41, 42, 43]
    assert [r[S.HOST] for r in rows] == ["b", "a", "a"]  # (timestamp, host) order
    b, a1, a2 = rows
    assert b[S.LOSS] and b[S.ERR] == "boom"
    assert a1[S.RT] == 12.35 and a1[S.LOSS] is False and a1[S.ERR] is None
    assert a2[S.LOSS] and a2[S.ERR] == S.LOSS_MESSAGE and a2[S.CREATED] == now


def test_apply_defaults(spark):
    df = spark.createDataFrame([("h", None)], f"{S.HOST} string, {S.LOSS} boolean")
    r = I.apply_defaults(df, AS_OF).first()
    assert r[S.LOSS] is False and r[S.TS] == AS_OF and r[S.CREATED] == AS_OF and r[S.RT] is None


def test_parse_json(spark):
    df = spark.createDataFrame(
        [("{\"target_host\": \"x\", \"response_time_ms\": 3.5}",), ("not json",), ("{\"k\": 1}",)], "value string"
    )
    valid, rejects = I.parse_probe_json(df)
    v = valid.collect()
    assert len(v) == 1 and v[0][S.HOST] == "x" and v[0][S.LOSS] is False
    assert sorted(r["reject_reason"] for r in rejects.collect()) == ["Invalid JSON format", "target_host required"]


def test_provider_info(spark):
    df = spark.createDataFrame([("{\"ip\": \"1.2.3.4\", \"city\": \"Oslo\", \"country\": \"NO\", \"org\": \"ISP\"}",), ("{}",)], "j string")
    rows = I.provider_info(df, "j").collect()
    assert rows[0]["provider"] == "ISP" and rows[0]["location"] == "Oslo, NO" and rows[0]["region"] == "Unknown"
    assert rows[1]["provider"] == "Unknown" and rows[1]["location"] == "--"


def test_drop_scratch(spark):
    import os

    from linkwatch.operators import downtime as D
    from linkwatch.session import drop_scratch

    drop_scratch(spark)
    dt = D.downtime_periods(load_pm(spark, SF_SMALL), AS_OF, hours=None, materialize=True)
    assert dt.count() > 0
    base = spark.conf.get("spark.checkpoint.dir").replace("file:", "")
    before = len(os.listdir(base))
    assert drop_scratch(spark) >= 1
    assert len(os.listdir(base)) < before


def test_message_sink_roundtrip(spark, tmp_path):
    from linkwatch.operators import watchlist as W
    from linkwatch.sources.sinks import write_messages

    msgs = W.emit_json(W.route_updates(W.probe_cycles(load_pm(spark, SF_SMALL))))
    write_messages(msgs, str(tmp_path / "m"))
    back = spark.read.json(str(tmp_path / "m"))
    assert back.count() == msgs.count()
    assert set(back.columns) == {"type", "timestamp", "results"}
    types = {r[0] for r in back.select("type").distinct().collect()}
    assert types <= {S.MSG_PING_UPDATE, S.MSG_DNS_UPDATE}


def test_hot_day_is_split_and_small_days_share_tasks(spark, tmp_path):
    """Files follow the size of the days, not one for each host and day."""
    import glob

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        pm = load_pm(spark, SF_SMALL)
        hot = spark.range(20_000).selectExpr("id + 1000000 AS id", "timestamp_ntz'2024-01-15 00:00:00' + make_dt_interval(0, 0, 0, id) AS timestamp", "'8.8.8.8' AS target_host", "rand(1) AS response_time_ms", "false AS packet_loss", "CAST(NULL AS STRING) AS error_message", "timestamp_ntz'2024-01-15 00:00:00' AS created_at")
        append_metrics(pm.unionByName(hot), str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    per_day = {}
    for f in glob.glob(str(tmp_path / "t" / "*" / "*" / "*.parquet")):
        day = f.split("metric_date=")[1].split("/")[0]
        per_day[day] = per_day.get(day, 0) + 1
    assert per_day["2024-01-15"] >= 2
    assert sum(n for d, n in per_day.items() if d != "2024-01-15") <= 2 * len(per_day)


def test_plans_run_nothing_when_built(spark, tmp_path):
    """No job runs before an action, on stored tables too."""
    from linkwatch.operators import downtime as D
    from linkwatch.operators import latest as L

    append_metrics(load_pm(spark, SF_SMALL), str(tmp_path / "t"))
    table = scan_metrics(spark, str(tmp_path / "t"))
    sc = spark.sparkContext
    sc.setJobGroup("build", "plan building")
    try:
        L.latest_per_host(table)
        D.downtime_periods(table, AS_OF, hours=None)
        D.affected_pings(table, AS_OF, hours=None)
        assert list(sc.statusTracker().getJobIdsForGroup("build")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_watchlist_remove_forgets_latest(spark):
    from linkwatch.operators import latest as L
    from linkwatch.operators import watchlist as W

    latest = L.latest_per_host(load_pm(spark, SF_SMALL))
    gone = latest.first()[S.HOST]
    left = {r[S.HOST] for r in W.forget_hosts(latest, [gone]).collect()}
    assert gone not in left and len(left) == latest.count() - 1


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from linkwatch.session import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session)
