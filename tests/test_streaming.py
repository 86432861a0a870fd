"""Streams equal batch; restart from checkpoint keeps state."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest

from conftest import AS_OF, T0, make_pm
from linkwatch import schema as S
from linkwatch.operators import downtime as D
from linkwatch.streaming import jobs as J
from stream_files import stage_batches, stage_files


def _rows(seed=1, n=300):
    rnd = random.Random(seed)
    rows, t = [], T0 - timedelta(hours=5)
    for i in range(n):
        t += timedelta(seconds=rnd.choice([3, 20, 90]))
        loss = rnd.random() < 0.4
        rows.append((i + 1, t, f"h{i % 3}", None if loss else 1.0, loss, None, t))
    return rows


def _batch(spark, rows):
    dt = D.downtime_periods(make_pm(spark, rows), AS_OF, hours=None, min_duration_seconds=30, chunk_unit="minute")
    return sorted((r[0], r[1], r[2]) for r in dt.collect())


def _stream_out(spark, path):
    df = spark.read.parquet(path).selectExpr("target_host", "CAST(start_time AS TIMESTAMP_NTZ) s", "CAST(end_time AS TIMESTAMP_NTZ) e")
    return sorted((r[0], r[1], r[2]) for r in df.collect())


def test_stream_downtime_equals_batch(spark, tmp_path):
    rows = _rows()
    base = str(tmp_path)
    stage_files(make_pm(spark, rows), f"{base}/in", n_files=3)
    src = J.read_metric_stream(spark, f"{base}/in")
    J.run_available_now(J.stream_downtime_keyed(src, 30), f"{base}/out", f"{base}/ckpt")
    assert _stream_out(spark, f"{base}/out") == _batch(spark, rows)


def test_stream_restart_keeps_state(spark, tmp_path):
    rows = _rows(seed=2)
    half = len(rows) // 2
    base = str(tmp_path)
    stage_files(make_pm(spark, rows[:half]), f"{base}/in", n_files=2)
    src = J.read_metric_stream(spark, f"{base}/in")
    J.run_available_now(J.stream_downtime_keyed(src, 30), f"{base}/out", f"{base}/ckpt")
    # second run: new files, same checkpoint -> outages spanning the split are found
    stage_files(make_pm(spark, rows[half:]), f"{base}/in", n_files=2, first_part=2)
    src = J.read_metric_stream(spark, f"{base}/in")
    J.run_available_now(J.stream_downtime_keyed(src, 30), f"{base}/out", f"{base}/ckpt")
    assert _stream_out(spark, f"{base}/out") == _batch(spark, rows)


def test_stream_latest_and_host_filter(spark, tmp_path):
    rows = _rows(seed=3, n=60)
    base = str(tmp_path)
    stage_files(make_pm(spark, rows), f"{base}/in", n_files=2)
    src = J.read_metric_stream(spark, f"{base}/in")
    J.run_available_now(J.stream_latest(src), f"{base}/latest", f"{base}/ck1", mode="complete")
    got = {r[S.HOST]: r[S.ID] for r in J.read_versions(spark, f"{base}/latest").collect()}
    want = {}
    for r in rows:
        want[r[2]] = r[0]
    assert got == want
    J.run_available_now(J.stream_host_filter(src, ["h1"]), f"{base}/sub", f"{base}/ck2")
    assert spark.read.parquet(f"{base}/sub").count() == sum(1 for r in rows if r[2] == "h1")


def test_stream_late_rows_are_skipped(spark, tmp_path):
    # newer half first, then a file with older rows: the older rows are late
    # for every host and must not create or close outages
    rows = _rows(seed=4, n=240)
    old, new = rows[:120], rows[120:]
    base = str(tmp_path)
    stage_files(make_pm(spark, new), f"{base}/in", n_files=1)
    src = J.read_metric_stream(spark, f"{base}/in")
    J.run_available_now(J.stream_downtime_keyed(src, 30), f"{base}/out", f"{base}/ckpt")
    stage_files(make_pm(spark, old), f"{base}/in", n_files=1, first_part=1)
    src = J.read_metric_stream(spark, f"{base}/in")
    J.run_available_now(J.stream_downtime_keyed(src, 30), f"{base}/out", f"{base}/ckpt")
    assert _stream_out(spark, f"{base}/out") == _batch(spark, new)


def test_stream_downtime_processor_api_equals_batch(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    with pytest.raises(ValueError):
        J.stream_downtime_keyed(J.read_metric_stream(spark, stage_files(make_pm(spark, _rows()), f"{tmp_path}/x", n_files=1)), api="processor")
    before = spark.conf.get(key, None)
    spark.conf.set(key, J.ROCKSDB_PROVIDER)
    try:
        _processor_equals_batch(spark, tmp_path)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _processor_equals_batch(spark, tmp_path):
    rows = _rows(seed=5)
    half = len(rows) // 2
    base = str(tmp_path)
    stage_files(make_pm(spark, rows[:half]), f"{base}/in", n_files=2)
    src = J.read_metric_stream(spark, f"{base}/in")
    J.run_available_now(J.stream_downtime_keyed(src, 30, api="processor"), f"{base}/out", f"{base}/ckpt")
    stage_files(make_pm(spark, rows[half:]), f"{base}/in", n_files=2, first_part=2)
    src = J.read_metric_stream(spark, f"{base}/in")
    J.run_available_now(J.stream_downtime_keyed(src, 30, api="processor"), f"{base}/out", f"{base}/ckpt")
    assert _stream_out(spark, f"{base}/out") == _batch(spark, rows)


def test_stream_ingest_json(spark, tmp_path):
    base = str(tmp_path)
    import os

    os.makedirs(f"{base}/in")
    with open(f"{base}/in/a.jsonl", "w") as f:
        f.write('{"target_host": "a", "response_time_ms": 1.5}\n')
        f.write("not json\n")
        f.write('{"target_host": "b", "packet_loss": true, "error_message": "x"}\n')
        f.write('{"response_time_ms": 3.0}\n')
    q1, q2 = J.stream_ingest_json(spark, f"{base}/in", f"{base}/t", f"{base}/rej", f"{base}/ck", {"availableNow": True})
    q1.awaitTermination()
    q2.awaitTermination()
    rows = {r[S.HOST]: r for r in spark.read.parquet(f"{base}/t").collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"][S.LOSS] is False and rows["b"][S.LOSS] is True and rows["b"][S.ERR] == "x"
    rej = sorted(r["reject_reason"] for r in spark.read.parquet(f"{base}/rej").collect())
    assert rej == ["Invalid JSON format", "target_host required"]


def test_write_latest_table(spark, tmp_path):
    rows = _rows(seed=6, n=40)
    base = str(tmp_path)
    stage_files(make_pm(spark, rows), f"{base}/in", n_files=2)
    src = J.read_metric_stream(spark, f"{base}/in")
    q = J.write_latest_table(J.stream_latest(src), f"{base}/snap", f"{base}/ck", trigger={"availableNow": True})
    q.awaitTermination()
    got = {r[S.HOST]: r[S.ID] for r in J.read_versions(spark, f"{base}/snap").collect()}
    want = {}
    for r in rows:
        want[r[2]] = r[0]
    assert got == want


def _feed(spark, batches, base, lateness="1 hour", **kw):
    src = J.read_metric_stream(spark, stage_batches(spark, batches, f"{base}/in", kw.pop("first_part", 0)))
    feed = J.downtime_of_feed(src, f"{base}/feed", 30 if not kw else kw["min_duration_seconds"], lateness)
    return feed, sorted((r[0], r[1], r[2]) for r in feed.outages().collect())


def test_feed_with_disorder_across_batches(spark, tmp_path):
    """20 s of disorder across two micro-batches: two outages, as in batch."""
    at = lambda k, loss: (k, T0 + timedelta(seconds=10 * k), "h", None if loss else 1.0, loss, None, T0)
    flags = [False, True, True, True, False, True, False]
    rows = [at(k, f) for k, f in enumerate(flags)]
    first, second = [rows[k] for k in (0, 1, 2, 5, 6)], [rows[k] for k in (3, 4)]
    _, got = _feed(spark, [first, second], tmp_path, min_duration_seconds=5)
    assert got == [("h", rows[1][1], rows[4][1]), ("h", rows[5][1], rows[6][1])]


@pytest.mark.parametrize("seed", [11, 12])
def test_shuffled_feed_equals_batch(spark, tmp_path, seed):
    """Rows shuffled within the lateness, over several micro-batches and a restart."""
    rnd, rows = random.Random(seed), _rows(seed=seed, n=260)
    mixed = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rnd.uniform(0, 50)))
    cut = len(mixed) // 3
    base = tmp_path
    _feed(spark, [mixed[:cut], mixed[cut : 2 * cut]], base)
    feed, got = _feed(spark, [mixed[2 * cut :]], base, first_part=2)
    assert got == _batch(spark, rows)
    assert feed.late_rows().count() == 0


def test_late_rows_go_to_their_own_output(spark, tmp_path):
    rows = _rows(seed=4, n=240)
    old, new = rows[:40], rows[120:]
    feed, got = _feed(spark, [new, old], tmp_path, lateness="1 minute")
    assert got == _batch(spark, new)
    assert sorted(r[S.ID] for r in feed.late_rows().collect()) == [r[0] for r in old]


def test_stream_and_batch_writers_share_a_table(spark, tmp_path):
    from linkwatch.operators.latest import latest_per_host
    from linkwatch.sources.metrics import append_metrics, apply_retention, next_id, scan_metrics

    rows, base = _rows(seed=8, n=120), str(tmp_path)
    raw = make_pm(spark, rows[:80]).selectExpr("target_host AS host", "response_time_ms", "packet_loss", "error_message", "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS timestamp")
    raw.coalesce(2).write.parquet(f"{base}/in")
    src = J.read_probe_stream(spark, f"{base}/in")
    for _ in range(2):  # the second run finds nothing new
        J.stream_ingest(src, f"{base}/t", f"{base}/ck", {"availableNow": True}).awaitTermination()
    append_metrics(make_pm(spark, rows[80:]), f"{base}/t")
    table = scan_metrics(spark, f"{base}/t")
    assert table.count() == 120 and table.where("id IS NULL").count() == 0
    assert table.select(S.ID).distinct().count() == 120
    assert next_id(spark, f"{base}/t") > 120
    got = sorted((r[0], r[1], r[2]) for r in D.downtime_periods(table, hours=None).collect())
    assert got == _batch(spark, rows)
    assert {r[S.HOST]: r[S.TS] for r in latest_per_host(table).collect()} == {r[2]: r[1] for r in rows}
    cut = sorted(r[1] for r in rows)[60]
    assert apply_retention(spark, f"{base}/t", cut + timedelta(days=1), days=1) == 60
    assert scan_metrics(spark, f"{base}/t").count() == 60


def test_batch_writer_refuses_a_file_sink_table(spark, tmp_path):
    from linkwatch.sources.metrics import append_metrics

    rows, base = _rows(seed=9, n=20), str(tmp_path)
    src = J.read_metric_stream(spark, stage_files(make_pm(spark, rows), f"{base}/in", n_files=1))
    J.run_available_now(src, f"{base}/sink", f"{base}/ck")
    with pytest.raises(ValueError):
        append_metrics(make_pm(spark, rows), f"{base}/sink")
