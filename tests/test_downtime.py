"""Outage detection: hand-made traps, brute-force property checks, formulations."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import AS_OF, T0, flags_to_rows, make_pm
from linkwatch import schema as S
from linkwatch.operators import downtime as D
from brute_force import outages

COLS = [S.HOST, "start_time", "end_time", "duration_seconds"]


def run(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=lambda t: (t[0], t[1]))


def periods(spark, flags, chunk_unit="minute", **kw):
    pm = make_pm(spark, flags_to_rows(flags))
    kw.setdefault("hours", None)
    kw.setdefault("min_duration_seconds", 1)
    return run(D.downtime_periods(pm, AS_OF, chunk_unit=chunk_unit, **kw))


def test_all_ok(spark):
    assert periods(spark, "FFFFF") == []


def test_all_lost_is_open(spark):
    assert periods(spark, "TTTTT") == []
    got = periods(spark, "TTTTT", include_open=True)
    assert len(got) == 1 and got[0][2] is None


def test_one_outage_threshold_inclusive(spark):
    assert [p[3] for p in periods(spark, "FTTTF", min_duration_seconds=30)] == [30.0]
    assert periods(spark, "FTTTF", min_duration_seconds=31) == []


def test_window_opening_lost(spark):
    got = periods(spark, "TTF")
    assert [(p[1], p[3]) for p in got] == [(T0, 20.0)]


def test_cut_by_window(spark):
    # window starts at the 3rd row: the outage starts there (filter before LAG)
    pm = make_pm(spark, flags_to_rows("FTTTF"))
    as_of = T0 + timedelta(seconds=20) + timedelta(hours=1)
    got = run(D.downtime_periods(pm, as_of, hours=1, min_duration_seconds=1, chunk_unit="minute"))
    assert [(p[1], p[3]) for p in got] == [(T0 + timedelta(seconds=20), 20.0)]


def test_open_tail(spark):
    assert len(periods(spark, "FTFT")) == 1
    assert len(periods(spark, "FTFT", include_open=True)) == 2


def test_alternating(spark):
    assert [p[3] for p in periods(spark, "TFTFTF")] == [10.0, 10.0, 10.0]


def test_null_flag_row_number_pairing(spark):
    # T, NULL, F, T, F: starts rows 1 and 4, one end (row 5) -> row 1 pairs with row 5
    got = periods(spark, "TNFTF")
    assert [(p[1], p[2]) for p in got] == [(T0, T0 + timedelta(seconds=40))]


def test_tied_times_order_by_id(spark):
    rows = [(2, T0, "h1", None, True, S.LOSS_MESSAGE, T0), (1, T0, "h1", 5.0, False, None, T0),
            (3, T0 + timedelta(seconds=10), "h1", 5.0, False, None, T0)]
    got = run(D.downtime_periods(make_pm(spark, rows), AS_OF, hours=None, min_duration_seconds=0))
    # order F(id 1), T(id 2), F: outage from id 2 to id 3
    assert [(p[1], p[2]) for p in got] == [(T0, T0 + timedelta(seconds=10))]


def test_two_hosts_no_leak(spark):
    rows = flags_to_rows("TFF", host="a") + flags_to_rows("FTF", host="b", first_id=100)
    got = run(D.downtime_periods(make_pm(spark, rows), AS_OF, hours=None, min_duration_seconds=1))
    assert [(p[0], p[1]) for p in got] == [("a", T0), ("b", T0 + timedelta(seconds=10))]


def test_hour_edge_booked_to_start_hour(spark):
    start = T0.replace(minute=59, second=50)
    rows = [(1, start, "h1", None, True, S.LOSS_MESSAGE, start),
            (2, start + timedelta(seconds=310), "h1", 3.0, False, None, start)]
    dt = D.downtime_periods(make_pm(spark, rows), AS_OF, hours=None, min_duration_seconds=1)
    by_hour = D.downtime_by_hour(dt).collect()
    assert len(by_hour) == 1
    assert by_hour[0]["hour_bucket"] == T0 and by_hour[0]["total_downtime"] == 310.0
    assert by_hour[0]["downtime_label"] == "5.2m"


def random_rows(seed, n_hosts=3, n=120, null_rate=0.0):
    rnd = random.Random(seed)
    rows, rid = [], 1
    for h in range(n_hosts):
        t = T0 - timedelta(hours=3)
        for _ in range(n):
            t += timedelta(seconds=rnd.choice([1, 5, 30, 70, 400]))
            u = rnd.random()
            loss = None if u < null_rate else (rnd.random() < 0.45)
            rows.append((rid, t, f"h{h}", None if loss else 1.0, loss, None, t))
            rid += 1
    return rows


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("chunk_unit", ["minute", "hour"])
def test_matches_brute_force(spark, seed, chunk_unit):
    rows = random_rows(seed, null_rate=0.15 if seed % 2 else 0.0)
    pm = make_pm(spark, rows)
    got = run(D.downtime_periods(pm, AS_OF, hours=None, min_duration_seconds=30, chunk_unit=chunk_unit))
    assert got == outages(rows, min_duration=30)
    since = AS_OF - timedelta(hours=30)
    got = run(D.downtime_periods(pm, AS_OF, hours=30, min_duration_seconds=1, chunk_unit=chunk_unit, include_open=True))
    assert got == outages(rows, since=since, min_duration=1, include_open=True, as_of=AS_OF)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(flags=st.text(alphabet="TFN", min_size=1, max_size=40), step=st.sampled_from([7, 29, 61]))
def test_property_random_series(spark, flags, step):
    rows = flags_to_rows(flags, step_s=step)
    got = run(D.downtime_periods(make_pm(spark, rows), AS_OF, hours=None, min_duration_seconds=0, chunk_unit="minute"))
    want = outages(rows, min_duration=0)
    assert got == want
    # without NULL flags periods are ordered and disjoint (with NULLs the
    # ordinal pairing can misalign starts and ends, by definition)
    if "N" not in flags:
        for a, b in zip(got, got[1:]):
            assert a[2] <= b[1]
    assert all(p[3] >= 0 for p in got)


@pytest.mark.parametrize("seed", range(3))
def test_formulations_agree_without_nulls(spark, seed):
    pm = make_pm(spark, random_rows(seed))
    kw = dict(hours=None, min_duration_seconds=30, chunk_unit="minute")
    a = run(D.downtime_periods(pm, AS_OF, **kw))
    b = run(D.downtime_next_edge(pm, AS_OF, **kw))
    c = run(D.downtime_pair_join(pm, AS_OF, **kw))
    assert a == b == c


def test_transitions_and_ordinals(spark):
    rows = random_rows(7, null_rate=0.1)
    pm = make_pm(spark, rows)
    tr = D.loss_transitions(pm, chunk_unit="minute").collect()
    assert len(tr) == len(rows)
    starts = D.outage_starts(pm, chunk_unit="minute").collect()
    assert sum(1 for r in tr if r["is_start"]) == len(starts)
    for h in {r[S.HOST] for r in starts}:
        rns = sorted(r["rn"] for r in starts if r[S.HOST] == h)
        assert rns == list(range(1, len(rns) + 1))


def test_derivatives_consistent(spark):
    rows = random_rows(3)
    pm = make_pm(spark, rows)
    dt = D.downtime_periods(pm, AS_OF, hours=None, min_duration_seconds=1, chunk_unit="minute")
    n = dt.count()
    by_hour = D.downtime_by_hour(dt).collect()
    assert sum(r["events"] for r in by_hour) == n
    filled = D.downtime_by_hour(dt, gap_fill=True).collect()
    assert sum(r["events"] for r in filled) == n and len(filled) >= len(by_hour)
    totals = D.downtime_totals(dt).collect()
    assert sum(r["total_events"] for r in totals) == n
    ords = D.event_ordinal(dt).collect()
    for h in {r[S.HOST] for r in ords}:
        mine = sorted(ords, key=lambda r: r["start_time"], reverse=True)
        mine = [r for r in mine if r[S.HOST] == h]
        assert [r["event_no"] for r in mine] == list(range(1, len(mine) + 1))
    rep = D.downtime_report(dt, None, 1).collect()
    assert sum(len(r["downtime_periods"]) for r in rep) == n
    assert all(r["total_downtime_events"] == sum(1 for x in ords if x[S.HOST] == r["host"]) for r in rep)
    aff = D.affected_pings(pm, AS_OF, hours=None, min_duration_seconds=1, chunk_unit="minute").collect()
    assert len(aff) == n
    for r in aff:
        want = sum(1 for x in rows if x[2] == r[S.HOST] and x[4] and r["start_time"] <= x[1] < r["end_time"])
        assert r["affected_pings"] == want


def test_lazy_plan_equals_materialised(spark):
    rows = random_rows(11, null_rate=0.1)
    pm = make_pm(spark, rows)
    kw = dict(hours=None, min_duration_seconds=1, chunk_unit="minute")
    lazy = D.downtime_periods(pm, AS_OF, materialize=False, **kw)
    assert "edges-" not in lazy._jdf.queryExecution().executedPlan().toString()
    assert run(lazy) == run(D.downtime_periods(pm, AS_OF, materialize=True, **kw)) == outages(rows, min_duration=1)
    t1 = sorted(tuple(r) for r in D.loss_transitions(pm, chunk_unit="minute", materialize=False).collect())
    t2 = sorted(tuple(r) for r in D.loss_transitions(pm, chunk_unit="minute", materialize=True).collect())
    assert t1 == t2


def test_affected_pings_of_an_open_outage(spark):
    pm = make_pm(spark, flags_to_rows("FTTT"))
    for unit in ("minute", "hour"):
        rows = D.affected_pings(pm, AS_OF, hours=None, min_duration_seconds=1, include_open=True, chunk_unit=unit).collect()
        assert [(r["end_time"], r["affected_pings"]) for r in rows] == [(None, 3)]
