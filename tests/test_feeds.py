"""Streams: cycle messages, subscriptions that change, outages by chunks of keyed state."""

from __future__ import annotations

import bisect
import json
import random
from datetime import timedelta

import numpy as np
from conftest import SF_SMALL, T0, flags_to_rows, make_pm
from pyspark.sql import functions as F
from stream_files import stage_batches

from linkwatch import schema as S
from linkwatch.operators import watchlist as W
from linkwatch.sources.metrics import load_pm
from linkwatch.streaming import cycles as C
from linkwatch.streaming import jobs as J
from linkwatch.streaming import outages as O
from linkwatch.streaming import subscriptions as U


def plain_outages(rows):
    """(start, end) of rows (ts, id, lost) in time order."""
    out, begin = [], None
    for ts, _, lost in sorted(rows):
        if lost and begin is None:
            begin = ts
        elif not lost and begin is not None:
            out.append((begin, ts))
            begin = None
    return out


def test_chunks_and_their_chain_equal_one_pass():
    summarize, chain = O._summarize(), O._chain()
    rng = random.Random(2)
    for _ in range(500):
        n, width = rng.randint(1, 40), rng.choice([1, 3, 10, 1000])
        p = rng.random()
        rows = [(rng.randint(0, 100), i, rng.random() < p) for i in range(n)]
        chunks = {}
        for r in rows:
            chunks.setdefault(r[0] // width, []).append(r)
        at, got = O.NONE, []
        for k in sorted(chunks):
            part = chunks[k]
            rng.shuffle(part)
            cols = [np.array([r[i] for r in part]) for i in range(3)]
            closed, at = chain(at, *summarize(*cols))
            got += closed
        assert got == plain_outages(rows)


def test_stream_outages_under_disorder(spark, tmp_path):
    """Rows of several hosts out of order within the lateness, over micro-batches, chunks and a gap."""
    rng = random.Random(5)
    rows = []
    for h in range(3):
        flags = "".join(rng.choice("TTTFFN"[h:]) for _ in range(90))
        part = flags_to_rows(flags, host=f"h{h}", step_s=37.0, first_id=1 + 1000 * h)
        rows += [r if i < 50 else (r[0], r[1] + timedelta(hours=3), *r[2:]) for i, r in enumerate(part)]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 4)))
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    late = (9_999, T0 + timedelta(seconds=5), "h0", None, True, None, T0)
    end = O.closing_row(spark, T0 + timedelta(days=1), S.METRICS_SCHEMA.__class__([f.__class__(f.name, f.dataType, True) for f in S.METRICS_SCHEMA.fields]))
    src = stage_batches(spark, [*batches, [late]], f"{tmp_path}/in")
    end.coalesce(1).write.parquet(f"{src}/part=99")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, J.ROCKSDB_PROVIDER)
    try:
        found = O.stream_outages(J.read_metric_stream(spark, src), 0, lateness="10 minutes", chunk_unit="minute")
        J.run_available_now(found, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    finally:
        spark.conf.unset(key)
    got = sorted((r[S.HOST], r["start_time"], r["end_time"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = []
    for h in range(3):
        mine = [(r[1], r[0], bool(r[4])) for r in rows if r[2] == f"h{h}"]
        want += [(f"h{h}", a, b) for a, b in plain_outages(mine)]
    assert got == sorted(want)


def test_cycle_messages_equal_batch(spark, tmp_path):
    """Messages of the cycles that are over, whole, from micro-batches that cut through cycles."""
    pm = load_pm(spark, SF_SMALL).limit(200)
    rows = sorted((tuple(r) for r in pm.collect()), key=lambda r: r[1])
    # Many probes in a few cycles, some of them late by a second.
    rows = [(r[0], T0 + timedelta(seconds=i * 0.7), *r[2:6], T0) for i, r in enumerate(rows)]
    order = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=r[0] % 3)))
    src = stage_batches(spark, [order[i : i + 45] for i in range(0, 200, 45)], f"{tmp_path}/in")
    C.stream_messages(J.read_metric_stream(spark, src), f"{tmp_path}/out", f"{tmp_path}/ckpt", lateness="5 seconds", parts=3, trigger={"availableNow": True}).awaitTermination()
    got = [json.loads(r["value"]) for r in spark.read.format("text").load(f"{tmp_path}/out").collect()]
    over = max(r[1] for r in rows) - timedelta(seconds=5)
    batch = make_pm(spark, rows)
    want = W.emit_json(W.route_updates(W.probe_cycles(batch, "10 seconds", shards=3)))
    want = [json.loads(r["value"]) for r in want.collect()]
    want = [m for m in want if m["timestamp"] <= over.isoformat(timespec="microseconds")]
    key = lambda m: json.dumps(m, sort_keys=True)
    assert len(want) > 5 and sorted(got, key=key) == sorted(want, key=key)
    # A second start writes nothing again.
    C.stream_messages(J.read_metric_stream(spark, src), f"{tmp_path}/out", f"{tmp_path}/ckpt", lateness="5 seconds", parts=3, trigger={"availableNow": True}).awaitTermination()
    assert spark.read.format("text").load(f"{tmp_path}/out").count() == len(got)


def _feed_files(spark, batches, path):
    """One file for each batch of (rows, messages)."""
    for i, (rows, messages) in enumerate(batches):
        both = U.merged_stream(make_pm(spark, rows), spark.createDataFrame(messages, U.MESSAGE_SCHEMA))
        both.coalesce(1).write.parquet(f"{path}/part={i}")
    schema = spark.read.parquet(path).drop("part").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).drop("part")


def test_subscription_between_two_micro_batches(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = flags_to_rows("F" * 30)  # one host, ten seconds apart
    other = flags_to_rows("F" * 30, host="h2", first_id=500)
    batches = [
        (rows[:10] + other[:10], [("a", "h1", at(35), 1, True)]),
        # b comes, a goes; a unsubscribes twice; c's messages of one time count by seq.
        (rows[10:20] + other[10:20], [("b", "h1", at(100), 2, True), ("a", "h1", at(150), 3, False), ("a", "h1", at(155), 4, False), ("c", "h2", at(120), 5, True), ("c", "h2", at(120), 6, False)]),
        ([], [("c", "h2", at(200), 7, True)]),
        (rows[20:] + other[20:], [("a", "h1", at(250), 8, True)]),
    ]
    feed = U.SubscriptionFeed(spark, f"{tmp_path}/feed")
    src = _feed_files(spark, batches, f"{tmp_path}/in")
    for _ in range(2):  # a second start delivers nothing again
        feed.start(src, {"availableNow": True}).awaitTermination()
    got = sorted((r[U.CLIENT], r[S.HOST], r[S.TS]) for r in feed.rows().collect())
    want = [("a", "h1", at(10 * i)) for i in (*range(4, 15), *range(25, 30))] + [("b", "h1", at(10 * i)) for i in range(10, 30)] + [("c", "h2", at(10 * i)) for i in range(20, 30)]
    assert got == sorted(want)


def test_spans_of_messages(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    messages = [("a", "h", at(0), 1, True), ("a", "h", at(5), 2, True), ("a", "h", at(9), 3, False), ("a", "g", at(1), 4, False), ("b", "h", at(3), 5, True)]
    spans = U.subscription_spans(spark.createDataFrame(messages, U.MESSAGE_SCHEMA)).orderBy(U.CLIENT, "begin").collect()
    assert [tuple(r) for r in spans] == [("a", "h", at(0), at(5)), ("a", "h", at(5), at(9)), ("b", "h", at(3), None)]
    empty = spark.createDataFrame([], U.MESSAGE_SCHEMA)
    assert U.subscribed_rows(make_pm(spark, flags_to_rows("FT")), empty).collect() == []


def test_spans_meet_the_rows_of_their_slots_only(spark):
    rng = random.Random(5)
    at = lambda s: T0 + timedelta(seconds=s)
    # A burst in the middle of a quiet time, rows of one time, and a host with few rows.
    times = [rng.uniform(0, 100_000) for _ in range(3000)] + [rng.uniform(50_000, 50_010) for _ in range(3000)] + [70_000.0] * 500
    rows = [(i, at(t), "h1", 1.0, False, None, at(t)) for i, t in enumerate(times)]
    rows += [(10_000 + i, at(1000 * i), "h2", 1.0, False, None, at(0)) for i in range(20)]
    told = [(f"c{rng.randint(0, 3)}", rng.choice(["h1", "h1", "h1", "h2", "h3"]), at(rng.choice(times) + rng.choice([0, 0.5])), i, rng.random() < 0.6) for i in range(3000)]
    told += [("early", "h1", at(-500), 9001, True), ("early", "h1", at(-400), 9002, False), ("always", "h1", at(-10), 9003, True)]
    pm, messages = make_pm(spark, rows), spark.createDataFrame(told, U.MESSAGE_SCHEMA)
    newest: dict = {}
    for c, h, t, seq, on in sorted(told, key=lambda m: (m[2], m[3])):
        newest.setdefault((c, h), []).append((t, on))
    want = []
    for (c, h), said in newest.items():
        for r in rows:
            k = bisect.bisect_right(said, r[1], key=lambda m: m[0])
            if r[2] == h and k and said[k - 1][1]:
                want.append((c, r[0]))
    assert sorted(tuple(r) for r in U.subscribed_rows(pm, messages).select(U.CLIENT, S.ID).collect()) == sorted(want)
    dealt, spans = U.dealt(pm, messages)
    met = dealt.groupBy(S.HOST, "_slot").count().join(spans.groupBy(F.col("_host").alias(S.HOST), "_slot").agg(F.count("*").alias("m")), [S.HOST, "_slot"])
    tried = met.agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    # Rows of one time share a slot; a span meets two slots' rows beyond those delivered.
    assert tried <= len(want) + len(told) * (2 * 2 * U.SHARED + 500)
    assert dealt.where(F.col(S.TS) != F.lit(at(70_000))).groupBy(S.HOST, "_slot").count().agg(F.max("count")).first()[0] <= 2 * U.SHARED
