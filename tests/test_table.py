"""The versioned fact table: snapshots, ids, compaction, retention, lookups, clustering."""

from __future__ import annotations

import glob
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from conftest import AS_OF, SF_MID, SF_SMALL, flags_to_rows, make_pm
from pyspark.sql import functions as F

from linkwatch import schema as S
from linkwatch.sources.metrics import load_pm
from linkwatch.sources.table import MetricTable, _rank, interleaved, stream_into
from linkwatch.streaming import jobs as J
from stream_files import stage_files


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def scanned_rows(df) -> int:
    """Rows that the file scans of a plan gave after row groups were left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    n = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            leaf = leaf.executedPlan().collectLeaves().apply(0)
        n += leaf.metrics().apply("numOutputRows").value()
    return n


def test_readers_keep_their_version(spark, tmp_path):
    t = MetricTable(spark, str(tmp_path / "t"))
    pm = load_pm(spark, SF_SMALL)
    for i in range(3):
        t.append(pm.where(F.col(S.ID) % 3 == i))
    held, version = t.scan(), t.state().version
    assert t.compact() == sum(_per_day_of(version, t).values())
    assert all(n == 1 for n in _per_day(t).values())
    cutoff = AS_OF - timedelta(days=10)
    want = pm.where(F.col(S.TS) < F.lit(cutoff)).count()
    assert t.retain(cutoff) == want and t.retain(cutoff) == 0
    assert same(t.scan().drop(S.METRIC_DATE), pm.where(F.col(S.TS) >= F.lit(cutoff)))
    # A reader that began before, and one of the earlier version.
    assert same(held.drop(S.METRIC_DATE), pm) and same(t.scan(version=version).drop(S.METRIC_DATE), pm)
    assert t.vacuum(keep=1) > 0
    assert same(t.scan().drop(S.METRIC_DATE), pm.where(F.col(S.TS) >= F.lit(cutoff)))


def _per_day(t):
    return _per_day_of(None, t)


def _per_day_of(version, t):
    out = {}
    for f in t.state(version).folders.values():
        out[f.day] = out.get(f.day, 0) + 1
    return out


def test_scan_lists_the_range_only(spark, tmp_path):
    t = MetricTable(spark, str(tmp_path / "t"))
    pm = load_pm(spark, SF_SMALL)
    t.append(pm)
    since, until = AS_OF - timedelta(days=5), AS_OF - timedelta(days=3, hours=7)
    got = t.scan(since, until)
    assert same(got.drop(S.METRIC_DATE), pm.where((F.col(S.TS) >= F.lit(since)) & (F.col(S.TS) < F.lit(until))))
    assert len(got.inputFiles()) < len(t.scan().inputFiles()) / 4


def test_ids_have_no_gaps_and_batches_count_once(spark, tmp_path):
    t = MetricTable(spark, str(tmp_path / "t"))
    rows = load_pm(spark, SF_SMALL).drop(S.ID)
    t.append(rows.limit(100), "a", 0)
    t.append(rows.limit(100), "a", 0)  # the same batch again
    t.append(rows.limit(70))
    t.append(rows.limit(30), "a", 1)
    ids = sorted(r[0] for r in t.scan().select(S.ID).collect())
    assert ids == list(range(1, 201))
    # Given ids stay, later ones begin after them.
    t.append(make_pm(spark, flags_to_rows("FT", first_id=1000)))
    t.append(rows.limit(5))
    assert sorted(r[0] for r in t.scan().select(S.ID).collect())[-7:] == [1000, 1001, 1002, 1003, 1004, 1005, 1006]


def test_a_batch_that_failed_takes_the_same_ids_again(spark, tmp_path, monkeypatch):
    t = MetricTable(spark, str(tmp_path / "t"))
    rows = load_pm(spark, SF_SMALL).drop(S.ID).limit(50)
    monkeypatch.setattr(t, "_publish_append", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.append(rows, "a", 0)
    monkeypatch.undo()
    t.append(rows, "b", 0)  # another writer meanwhile
    t.append(rows, "a", 0)
    assert sorted(r[0] for r in t.scan().select(S.ID).collect()) == list(range(1, 101))


def test_two_writers(spark, tmp_path):
    """A version that another writer took is not overwritten, and a compaction of folders that are gone is dropped."""
    t, u = MetricTable(spark, str(tmp_path / "t")), MetricTable(spark, str(tmp_path / "t"))
    pm = load_pm(spark, SF_SMALL)
    t.append(pm.limit(100))
    tried = []

    def change(state):
        if not tried:
            u.append(pm.limit(10))  # takes the next version first
        tried.append(state.version)
        return {"operation": "note"}

    t.commit(change)
    assert len(tried) == 2 and t.scan().count() == 110
    old = list(t.state().folders.values())
    u.retain(AS_OF)
    assert t.replace(old, t.read(old), "compact", 1) is None
    assert t.scan().count() == 0


def test_stream_of_many_batches_is_compacted(spark, tmp_path):
    src = str(tmp_path / "src")
    pm = load_pm(spark, SF_SMALL).drop(S.ID).withColumn(S.ID, F.lit(None).cast("long")).select(*S.METRIC_COLUMNS)
    stage_files(pm, src, n_files=12)
    t = MetricTable(spark, str(tmp_path / "t"))
    rows = J.read_metric_stream(spark, src).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.METRICS_SCHEMA.fields])
    stream_into(rows, t, str(tmp_path / "ckpt"), {"availableNow": True}, compact_every=5).awaitTermination()
    assert t.state().done == {k: 11 for k in t.state().done}
    assert sorted(r[0] for r in t.scan().select(S.ID).collect()) == list(range(1, pm.count() + 1))
    t.compact()
    assert all(n == 1 for n in _per_day(t).values())
    files = t.scan().inputFiles()
    assert len(files) <= 2 * len(_per_day(t))
    # A new start of the query adds nothing.
    stream_into(rows, t, str(tmp_path / "ckpt"), {"availableNow": True}).awaitTermination()
    assert t.scan().count() == pm.count()


def test_lookup_reads_the_files_that_may_hold_the_id(spark, tmp_path):
    """Ids in no order with time: only the bloom filter can leave files out."""
    t = MetricTable(spark, str(tmp_path / "t"))
    pm = load_pm(spark, SF_MID).withColumn(S.ID, F.xxhash64(S.ID).bitwiseAND(F.lit(2**62 - 1)))
    t.append(pm)
    n = pm.count()
    for r in pm.orderBy(S.RT).limit(3).collect():
        found = t.by_id(r[S.ID])
        assert [x[S.TS] for x in found.collect()] == [r[S.TS]]
        assert scanned_rows(t.scan().where(F.col(S.ID) == r[S.ID])) < n / 10
    assert t.by_id(5).collect() == []


def test_compacted_files_skip_hosts_and_responses(spark, tmp_path):
    """Share of files whose statistics rule a predicate out."""
    pm = load_pm(spark, SF_MID).withColumn(S.TS, F.expr("timestamp_ntz'2024-01-10 00:00:00' + make_dt_interval(0, 0, 0, id % 86400)"))
    t = MetricTable(spark, str(tmp_path / "t"))
    for i in range(2):
        t.append(pm.where(F.col(S.ID) % 2 == i))
    size = sum(f.bytes for f in t.state().folders.values())
    t.compact(target_bytes=size // 40)
    if any(n > 1 for n in _per_day(t).values()):  # both were larger than the target
        t.replace(list(t.state().folders.values()), t.read(t.state().folders.values()), "compact", 40)
    stats = []
    for f in glob.glob(str(tmp_path / "t" / "data" / "w=compact*" / "*" / "*.parquet")):
        group = pq.ParquetFile(f).metadata.row_group(0)
        cols = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        stats.append({c: (cols[c].min, cols[c].max) for c in (S.HOST, S.RT, S.TS)})
    assert len(stats) >= 20
    skipped = lambda c, low, high: sum(s[c][1] < low or s[c][0] > high for s in stats) / len(stats)
    assert skipped(S.HOST, "google.com", "google.com") > 0.4
    low, high = pm.selectExpr(f"percentile({S.RT}, 0.40)", f"percentile({S.RT}, 0.45)").first()
    assert skipped(S.RT, low, high) > 0.4
    assert skipped(S.TS, datetime(2024, 1, 10, 4), datetime(2024, 1, 10, 5)) > 0.4


def test_curve(spark):
    r = spark.range(300).select(_rank(F.col("id"), [10, 20, 30, 200, 250]).alias("r"), "id").collect()
    assert all(x["r"] == sum(b <= x["id"] for b in (10, 20, 30, 200, 250)) * 256 // 6 for x in r)
    z = spark.range(1).select(interleaved(F.lit(0b101), F.lit(0b011)).alias("z")).first()["z"]
    assert z == 0b100111


def test_empty_rows(spark, tmp_path):
    t = MetricTable(spark, str(tmp_path / "t"))
    assert t.scan().collect() == [] and t.compact() == 0 and t.retain(AS_OF) == 0 and t.vacuum() == 0
    t.append(load_pm(spark, SF_SMALL).where("false"), "a", 0)
    assert t.scan().collect() == [] and t.state().done == {"a": 0}


def test_compacted_files_have_few_rows_however_they_compress(spark, tmp_path, monkeypatch):
    from linkwatch.sources import versions as V

    monkeypatch.setattr(V, "TARGET_ROWS", 1000)
    t = MetricTable(spark, str(tmp_path / "t"))
    rows = spark.range(8000).select(F.col("id").alias(S.ID), F.lit(AS_OF).cast("timestamp_ntz").alias(S.TS), F.lit("h").alias(S.HOST), F.col("id").cast("double").alias(S.RT), F.lit(False).alias(S.LOSS))
    for i in range(2):
        t.append(rows.where(F.col(S.ID) % 2 == i))
    assert t.compact() == 2 and t.scan().count() == 8000
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/t/data/w=compact-*/**/*.parquet", recursive=True)]
    assert sum(sizes) == 8000 and max(sizes) <= 2000
