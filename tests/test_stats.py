"""Aggregates, recency, presentation on hand-made tables."""

from __future__ import annotations

from datetime import timedelta

import pytest

from conftest import AS_OF, T0, flags_to_rows, make_pm
from linkwatch import schema as S
from linkwatch.functions import present as PR
from linkwatch.operators import filters as P
from linkwatch.operators import latest as L
from linkwatch.operators import stats as A
from linkwatch.sources.metrics import seed_rows


def test_empty_host_row(spark):
    pm = make_pm(spark, flags_to_rows("FFT", host="a"))
    rows = {r["host"]: r for r in A.host_summary(pm, AS_OF, hosts=["a", "missing"], full_history=True).collect()}
    m = rows["missing"]
    assert m["total_pings"] == 0 and m["uptime_percentage"] == 0.0
    assert m["avg_response_time"] is None and m["median_response_time"] is None and m["packet_loss_rate"] is None
    a = rows["a"]
    assert a["total_pings"] == 3 and a["packet_losses"] == 1
    assert a["packet_loss_rate"] == pytest.approx(1 / 3)
    assert a["uptime_percentage"] == pytest.approx(100 - 100 / 3)


def test_all_lost_summary(spark):
    pm = make_pm(spark, flags_to_rows("TTTTT"))
    r = A.host_summary(pm, AS_OF, full_history=True).first()
    assert r["avg_response_time"] is None and r["uptime_percentage"] == 0.0 and r["total_pings"] == 5


def test_even_count_percentiles(spark):
    rows = [(i + 1, T0 + timedelta(seconds=i), "h", v, v is None, None, T0) for i, v in enumerate([1.0, 2.0, None])]
    r = A.host_summary(make_pm(spark, rows), AS_OF, full_history=True).first()
    assert r["median_response_time"] == 1.5
    assert r["p95_response_time"] == pytest.approx(1.95)
    assert r["avg_response_time"] == 1.5 and r["total_pings"] == 3


def test_window_echo(spark):
    pm = make_pm(spark, flags_to_rows("FF", start=AS_OF - timedelta(minutes=30)))
    r = A.host_summary(pm, AS_OF, minutes=90).first()
    assert (r["hours_analyzed"], r["minutes_analyzed"]) == (1.5, 90.0)
    r = A.host_summary(pm, AS_OF).first()
    assert (r["hours_analyzed"], r["minutes_analyzed"]) == (24.0, 1440.0)
    r = A.host_summary(pm, AS_OF, hours=500).first()  # any window; requests are checked in operators.api
    assert (r["hours_analyzed"], r["minutes_analyzed"]) == (500.0, 30000.0)


def test_hourly_units_and_rates(spark):
    pm = make_pm(spark, flags_to_rows("FTFF", start=AS_OF - timedelta(hours=2)))
    r = A.hourly_stats(pm, AS_OF).first()
    assert r["packet_count"] == 4 and r["packet_loss_rate"] == 25.0  # percent
    d = A.hourly_stats(pm, AS_OF, unit="day").first()
    assert d["hour_bucket"] == (AS_OF - timedelta(hours=2)).replace(hour=0)


def test_recent_cap_and_pages(spark):
    rows = flags_to_rows("F" * 1001, start=AS_OF - timedelta(hours=3), step_s=1)
    pm = make_pm(spark, rows)
    assert L.recent_metrics(pm, AS_OF, offset=1000, cap=1000).count() == 0
    assert L.recent_metrics(pm, AS_OF, offset=1000).count() == 1
    assert L.recent_metrics(pm, AS_OF, limit=5000).count() == 1001
    assert L.recent_metrics(pm, AS_OF, limit=5000, cap=1000).count() == 1000
    first = L.recent_metrics(pm, AS_OF, limit=2).collect()
    assert [r[S.ID] for r in first] == [1001, 1000]


def test_latest_two_forms_and_ties(spark):
    rows = [(1, T0, "h", 1.0, False, None, T0), (2, T0, "h", 2.0, False, None, T0), (3, T0 - timedelta(1), "g", 3.0, False, None, T0)]
    pm = make_pm(spark, rows)
    a = sorted(tuple(r) for r in L.latest_per_host(pm).collect())
    b = sorted(tuple(r) for r in L.latest_per_host_rank(pm).collect())
    c = sorted(tuple(r) for r in L.latest_per_host(pm, method="max_by").collect())
    assert a == b == c and [r[0] for r in a] == [2, 3]
    assert L.latest_metric(pm, "h").first()[S.ID] == 2
    m = {k: v for r in L.latest_map(pm).collect() for k, v in r["latest"].items()}
    assert set(m) == {"h", "g"} and m["h"][S.ID] == 2


def test_tiers(spark):
    df = spark.createDataFrame([(x,) for x in (99.5, 99.49, 99.0, 95.0, 94.99)], "uptime_percentage double")
    got = [(r["status"], r["tier"]) for r in PR.with_reliability(df).collect()]
    assert got == [("Excellent", "primary"), ("Good", "secondary"), ("Good", "secondary"), ("Fair", "muted"), ("Poor", "muted")]


def test_retention_boundary(spark):
    cut = AS_OF - timedelta(days=30)
    rows = [(i + 1, cut + timedelta(microseconds=d), "h", 1.0, False, None, cut) for i, d in enumerate((-1, 0, 1))]
    pm = make_pm(spark, rows)
    assert P.retention_expired(pm, AS_OF, 30).count() == 1
    assert P.retention_keep(pm, AS_OF, 30).count() == 2
    assert P.retention_count(pm, AS_OF, 30).first()["deleted_count"] == 1


def test_seed_rows_summary(spark):
    pm = seed_rows(spark)
    out = {r["host"]: r for r in A.host_summary(pm, AS_OF, full_history=True).collect()}
    assert set(out) == {"8.8.8.8", "1.1.1.1", "google.com"}
    assert all(r["uptime_percentage"] == 100.0 for r in out.values())
    assert P.dns_only(pm).count() == 2


def test_counts_and_filters(spark):
    pm = make_pm(spark, flags_to_rows("FTF", host="a", start=AS_OF - timedelta(hours=2))
                 + flags_to_rows("FF", host="b", first_id=10, start=AS_OF - timedelta(days=3)))
    assert A.metrics_count(pm, AS_OF).first()["count"] == 5
    assert A.metrics_count(pm, AS_OF, hours=24).first()["count"] == 3
    assert A.metrics_count(pm, AS_OF, hours=0, host="").first()["count"] == 5  # falsy = no filter
    assert A.metrics_count(pm, AS_OF, host="b").first()["count"] == 2
    assert sorted(r[0] for r in A.distinct_hosts(pm).collect()) == ["a", "b"]
    assert A.live_host_count(pm).first()["live_hosts"] == 2
    assert P.metric_by_id(pm, 10).count() == 1 and P.metric_by_id(pm, 999).count() == 0
    from linkwatch.operators.api import request

    for name, bad in (("hourly_stats", {"hours": 169}), ("downtime_periods", {"min_duration_seconds": 0}), ("retention_count", {"days": 366}), ("recent_metrics", {"limit": 0}), ("nothing", {})):
        with pytest.raises(ValueError):
            request(name, pm, AS_OF, **bad)
    assert request("metrics_count", pm, AS_OF, hours=24).first()["count"] == 3
    assert A.hourly_stats(pm, AS_OF, hours=720).count() > 0  # the operator takes any window
    with pytest.raises(ValueError):
        P.range_minutes("2w")


def test_chart_series_and_current(spark):
    pm = make_pm(spark, flags_to_rows("FTFF", start=AS_OF - timedelta(minutes=5)))
    pts = P.chart_series(pm, AS_OF, host="h1", preset="1hr").collect()
    assert len(pts) == 3 and all(p["response_time"] is not None for p in pts)
    assert [p["time"] for p in pts][0] == (AS_OF - timedelta(minutes=5)).strftime("%H:%M:%S")
    cur = L.current_response(pm, AS_OF, preset="1hr").first()
    assert cur["current_response_time"] == 13.0 and cur["current_response_label"] == "13.0ms"


def test_summary_by_range_matches_single_windows(spark):
    pm = make_pm(spark, flags_to_rows("FTFFTF" * 20, start=AS_OF - timedelta(days=2), step_s=1500))
    by = {r["range_preset"]: r for r in A.summary_by_range(pm, AS_OF).collect()}
    for preset, minutes in S.RANGE_PRESETS.items():
        one = A.host_summary(pm, AS_OF, minutes=minutes).first()
        if preset not in by:
            assert one["total_pings"] == 0 if one else True
            continue
        assert by[preset]["total_pings"] == one["total_pings"]
        assert by[preset]["median_response_time"] == one["median_response_time"]


def test_host_input_and_url_component(spark):
    df = spark.createDataFrame([("  my host/a b  ",)], "h string")
    r = df.select(PR.host_input("h").alias("t"), PR.url_component(PR.host_input("h")).alias("u")).first()
    assert r["t"] == "my host/a b" and r["u"] == "my%20host%2Fa%20b"


def test_duplicate_keys(spark):
    rows = flags_to_rows("FF") + flags_to_rows("F")  # id 1 twice at T0
    out = P.duplicate_keys(make_pm(spark, rows)).collect()
    assert [(r[S.ID], r["duplicates"]) for r in out] == [(1, 2)]


def test_documented_label_rules(spark):
    from datetime import datetime

    df = spark.createDataFrame([(1.005, 2.675, datetime(2024, 1, 2, 0, 0, 5))], "a double, b double, t timestamp_ntz")
    r = df.select(
        PR.fixed("a", 2).alias("a2"),
        PR.fixed("b", 2, "ms").alias("b2"),
        PR.fixed("b", 1, "%").alias("b1"),
        PR.clock_label("t").alias("clock"),
        PR.bucket_label("t").alias("label"),
    ).first()
    # half-up on the decimal value (a browser's toFixed gives 1.00 for 1.005)
    assert r["a2"] == "1.01" and r["b2"] == "2.68ms" and r["b1"] == "2.7%"
    # 24-hour clock, midnight as 00
    assert r["clock"] == "00:00:05" and r["label"] == "Jan 2, 00:00"


def test_orders(spark):
    """The sorted forms come in the order that the API promises."""
    rows = [(i, T0 - timedelta(hours=i % 5), f"h{i % 3}", 1.0, False, None, T0) for i in range(40)]
    pm = make_pm(spark, rows)
    hours = [(r["hour_bucket"], r[S.HOST]) for r in A.hourly_stats(pm, AS_OF, hours=None, sort=True).collect()]
    assert hours == sorted(hours, key=lambda x: (-x[0].timestamp(), x[1]))
    assert [r[0] for r in A.distinct_hosts(pm, sort=True).collect()] == ["h0", "h1", "h2"]
    from linkwatch.operators.downtime import downtime_periods

    flags = make_pm(spark, flags_to_rows("FTTTTFTTTTFFTTTTF" * 4, start=AS_OF - timedelta(hours=2)))
    starts = [r["start_time"] for r in downtime_periods(flags, AS_OF, sort=True).collect()]
    assert len(starts) > 4 and starts == sorted(starts, reverse=True)
    times = [r[S.TS] for r in P.chart_series(make_pm(spark, flags_to_rows("F" * 50, start=AS_OF - timedelta(minutes=30))), AS_OF).collect()]
    assert len(times) == 50 and times == sorted(times)


def test_percentiles_by_rank_equal_interpolation(spark):
    """Random values, ties, single values and none, against the definition."""
    import random as rnd

    r, rows = rnd.Random(5), []
    for host, values in {
        "many": [r.lognormvariate(3, 1) for _ in range(300)],
        "ties": [5.0] * 40 + [7.0] * 41,
        "one": [3.25],
        "two": [1.0, 2.0],
        "none": [],
        "wide": [0.0, 1e9, 1.0, 2.0, 3.0],
    }.items():
        for i, v in enumerate([*values, None]):
            rows.append((len(rows), AS_OF - timedelta(minutes=i), host, v, v is None, None, AS_OF))
    got = {x["host"]: x for x in A.host_summary(make_pm(spark, rows), AS_OF, full_history=True).collect()}

    def want(host, p):
        v = sorted(x[3] for x in rows if x[2] == host and x[3] is not None)
        if not v:
            return None
        at = p * (len(v) - 1)
        low, high = v[int(at)], v[-int(-at // 1)]
        return low + (high - low) * (at - int(at))

    for host, x in got.items():
        for name, p in (("median_response_time", 0.5), ("p95_response_time", 0.95)):
            assert x[name] == (None if want(host, p) is None else pytest.approx(want(host, p)))
    total = A.overall_summary(make_pm(spark, rows), AS_OF, full_history=True).first()
    assert total["total_pings"] == len(rows)
