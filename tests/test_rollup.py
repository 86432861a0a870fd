"""Maintained rollups, pages found by counts, keyed stores."""

from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import AS_OF, SF_SMALL, flags_to_rows, make_pm
from pyspark.sql import functions as F
from test_table import same, scanned_rows

from linkwatch import schema as S
from linkwatch.operators import latest as L
from linkwatch.operators import rollup as R
from linkwatch.operators import stats as A
from linkwatch.sources.keyed import KeyedStore, latest_store, put_latest
from linkwatch.sources.metrics import load_pm
from linkwatch.sources.table import MetricTable


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def test_rollup_equals_recomputation(spark, tmp_path):
    """After appends, late rows, compaction and retention."""
    pm = load_pm(spark, SF_SMALL).where(F.col(S.TS) >= F.lit(AS_OF - timedelta(days=6)))
    t = MetricTable(spark, str(tmp_path / "t"))
    r = R.Rollup(spark, str(tmp_path / "r"), t)
    check = lambda: same(rounded(r.scan().drop(r.day)), rounded(R.hourly_partials(t.scan())))
    assert r.refresh() == 0
    t.append(pm.where(F.col(S.ID) % 3 == 0))
    assert r.refresh() > 3 and check()
    assert r.refresh() == 0
    # Late rows of one date: only that date is written.
    day = AS_OF.date() - timedelta(days=4)
    t.append(pm.where((F.col(S.ID) % 3 == 1) & (F.to_date(S.TS) == F.lit(day))))
    untouched = {f for f in r.state().folders.values() if f.day != str(day)}
    assert r.refresh() == 1 and check()
    assert untouched <= set(r.state().folders.values())
    t.append(pm.where(F.col(S.ID) % 3 == 2))
    t.compact()
    r.refresh()
    assert check()
    t.compact()
    assert r.refresh() == 0 and check()
    t.retain(AS_OF - timedelta(days=3, hours=5))
    assert r.refresh() > 0 and check()
    for unit in ("hour", "day", "week"):
        want = A.hourly_stats(t.scan(), AS_OF, hours=None, unit=unit)
        assert same(rounded(R.trend(r.scan(), unit).select(*want.columns)), rounded(want))


def test_rollup_of_lost_probes(spark, tmp_path):
    t = MetricTable(spark, str(tmp_path / "t"))
    r = R.Rollup(spark, str(tmp_path / "r"), t)
    t.append(make_pm(spark, flags_to_rows("TTT")))
    r.refresh()
    row = R.trend(r.scan(), "day").first()
    assert row["avg_response_time"] is None and row["packet_count"] == 3 and row["packet_loss_rate"] == 100.0


@pytest.mark.parametrize("offset, limit, host", [(0, 10, None), (0, 5000, None), (437, 100, None), (995, 100, None), (1000, 5, None), (3, 0, None), (40, 30, "google.com")])
def test_page_equals_sort(spark, tmp_path, offset, limit, host):
    pm = load_pm(spark, SF_SMALL)
    rows = sorted((r for r in pm.collect() if host in (None, r[S.HOST])), key=lambda r: (r[S.TS], r[S.ID]), reverse=True)
    want = [r[S.ID] for r in rows[offset : offset + limit]]
    assert [r[S.ID] for r in L.metrics_page(pm, offset, limit, host).collect()] == want
    hourly = R.hourly_partials(pm)
    assert [r[S.ID] for r in L.metrics_page(pm, offset, limit, host, hourly).collect()] == want


def test_page_with_many_rows_of_one_second(spark):
    rows = flags_to_rows("F" * 50, step_s=0.0) + flags_to_rows("F" * 50, step_s=0.01, first_id=100, host="h2")
    pm = make_pm(spark, rows)
    every = sorted(((r[1], r[0]) for r in rows), reverse=True)
    got, after = [], None
    while True:
        page = L.metrics_page(pm, 0, 7) if after is None else L.next_page(pm, after, 7)
        page = [(r[S.TS], r[S.ID]) for r in page.collect()]
        if not page:
            break
        got += page
        after = page[-1]
    assert got == every
    assert [r[S.ID] for r in L.metrics_page(pm, 33, 20).collect()] == [x[1] for x in every[33:53]]


def test_deep_page_reads_its_range_only(spark, tmp_path):
    t = MetricTable(spark, str(tmp_path / "t"))
    pm = load_pm(spark, SF_SMALL)
    t.append(pm)
    page = L.metrics_page(t.scan(), 900, 20)
    assert [r[S.ID] for r in page.collect()] == [r[S.ID] for r in pm.orderBy(F.desc(S.TS), F.desc(S.ID)).offset(900).limit(20).collect()]
    assert scanned_rows(page) < 120
    limits = page._jdf.queryExecution().executedPlan().toString()
    assert "limit=1000" not in limits and "limit=920" not in limits


def test_latest_store_writes_changed_hosts(spark, tmp_path):
    store = latest_store(spark, str(tmp_path / "s"))
    pm = load_pm(spark, SF_SMALL)
    batches = [pm.where(F.col(S.ID) % 4 == i) for i in range(4)] + [pm.where(f"{S.HOST} = 'google.com'").limit(3)]
    for i, b in enumerate(batches):
        before = store.state()
        put_latest(store, b, "w", i)
        added = [f for k, f in store.state().folders.items() if k not in before.folders]
        assert sum(f.rows for f in added) == b.select(S.HOST).distinct().count()
        put_latest(store, b, "w", i)  # again: nothing
    want = L.latest_per_host(pm)
    assert same(store.current(), want)
    held, version = store.current(), store.state().version
    assert store.fold() > 1 and same(store.current(), want) and same(held, want) and same(store.current(version), want)
    assert store.scan().count() == want.count()
    # A row older than the stored one changes nothing.
    put_latest(store, pm.orderBy(S.TS).limit(20), "w", 9)
    assert same(store.current(), want)


def test_later_put_wins_without_an_order(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("at", T.TimestampNTZType()), T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    store = KeyedStore(spark, str(tmp_path / "s"), schema, "at", ["at", "k"])
    for i, n in enumerate((5, 7, 6)):
        store.put(spark.createDataFrame([(AS_OF, "a", n), (AS_OF, f"b{i}", n)], schema), "w", i)
    assert sorted((r["k"], r["n"]) for r in store.current().collect()) == [("a", 6), ("b0", 5), ("b1", 7), ("b2", 6)]


def test_shards_follow_the_hosts(spark):
    from linkwatch.operators import watchlist as W

    few = make_pm(spark, flags_to_rows("FT"))
    many = make_pm(spark, [r for h in range(2600) for r in flags_to_rows("F", host=f"h{h}", first_id=h)])
    for pm, least in ((few, 1), (many, 3)):
        maps = L.latest_map(pm).collect()
        assert least <= len(maps) <= least + 1 and sum(len(r["latest"]) for r in maps) == pm.select(S.HOST).distinct().count()
        assert least <= W.probe_cycles(pm).where(F.col("cycle_start") == F.lit(pm.first()[S.TS])).count() <= least + 1
    assert L.latest_map(few.where("false")).collect() == []
