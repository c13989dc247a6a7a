"""Continuous jobs over staged files: twins of batch results, late rows, repeats and restarts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapework.sources import topics
from tapework import schemas as S
from tapework.streaming import candles as C
from tapework.streaming import expiry, latency, online, upkeep

T0 = dt.datetime(2026, 1, 7, 10, 0, 0)


def message(offset, close, minute=None, ticker="EURUSD", interval="1m", **more):
    at = T0 + dt.timedelta(minutes=offset if minute is None else minute)
    value = {"ticker": ticker, "timestamp": at.isoformat(), "interval": interval, "period": "1d",
             "open": close, "high": close, "low": close, "close": close, "volume": 0, **more}
    return (ticker, json.dumps(value), "instant_x", 0, offset)


@pytest.fixture
def topic(spark, tmp_path):
    path = str(tmp_path / "topic")

    def send(rows):
        spark.createDataFrame(rows, topics.RECORD).coalesce(1).write.mode("append").parquet(path)
    return path, send


def read(spark, path):
    return topics.decode(C.from_files(spark, path))


def test_land_in_two_runs_equals_one_batch(spark, topic, tmp_path):
    path, send = topic
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    send([message(i, 1.0 + i) for i in range(5)])
    C.land(C.from_files(spark, path), out, chk).awaitTermination()
    send([message(i, 1.0 + i) for i in range(5, 8)])
    C.land(C.from_files(spark, path), out, chk).awaitTermination()
    assert sorted(r.offset for r in spark.read.parquet(out).collect()) == list(range(8))


def test_quarantine(spark, topic, tmp_path):
    path, send = topic
    send([message(0, 1.0), ("k", "junk", "t", 0, 1), ("k", "[1]", "t", 0, 2), message(3, 2.0)])
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    C.quarantine(C.from_files(spark, path), good, bad, str(tmp_path / "chk")).awaitTermination()
    assert sorted(r.offset for r in spark.read.parquet(good).collect()) == [0, 3]
    assert sorted(r.payload for r in spark.read.parquet(bad).collect()) == ["[1]", "junk"]


def test_suppression_state_survives_between_runs(spark, topic, tmp_path):
    path, send = topic
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    run = lambda: C.to_table(C.suppressed(read(spark, path)), out, chk).awaitTermination()
    send([message(0, 1.0, 0), message(1, 1.0, 0), message(2, 1.5, 0), message(3, 1.5, 3, interval="tick"),
          message(4, 1.6, 4, interval="tick")])
    run()
    # The candle of the first run is known in the second one.
    send([message(5, 1.5, 0), message(6, 1.5, 6, interval="tick"), message(7, 1.5, 7), message(8, 9.0, 8, ticker="B")])
    run()
    assert sorted(r.offset for r in spark.read.parquet(out).collect()) == [0, 2, 4, 7, 8]


def test_latest_by_arrival(spark, topic, tmp_path):
    path, send = topic
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    send([message(0, 1.0), message(1, 2.0, interval="tick"), message(2, 3.0, minute=-50)])
    C.keep_latest(read(spark, path), out, chk).awaitTermination()
    send([message(3, 4.0, interval="tick")])
    C.keep_latest(read(spark, path), out, chk).awaitTermination()
    got = {r.interval: r.close for r in C.read_latest(spark, out).collect()}
    assert got == {"1m": 1.0, "tick": 4.0}  # by time, not by offset: these compare only inside a partition
    fresh = C.read_fresh(spark, out, F.lit("2026-01-07 10:03:30").cast("timestamp"), 60).collect()
    assert [r.interval for r in fresh] == ["tick"]


def test_candles_merge_late_rows_within_the_watermark(spark, topic, tmp_path):
    path, send = topic
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    run = lambda: C.to_table(C.candles(C.with_event_time(read(spark, path)), "5 minutes", "10 minutes"), out, chk).awaitTermination()
    send([message(0, 1.0, 0, open=0.5, volume=100), message(1, 5.0, 4, volume=50), message(2, 2.0, 12)])
    run()
    send([message(3, 9.0, 3, volume=7), message(4, 3.0, 30)])      # minute 3 is late but inside ten minutes
    run()
    send([message(5, 7.0, 1), message(6, 4.0, 60)])      # minute 1 is now too late
    run()
    got = {r.bucket.minute: r for r in spark.read.parquet(out).collect()}
    assert (got[0].open, got[0].high, got[0].low, got[0].close, got[0].volume) == (0.5, 9.0, 1.0, 5.0, 157)
    assert 10 in got and 60 not in got


def test_dual_sink_ignores_existing_keys(spark, topic, tmp_path):
    path, send = topic
    table, updates, chk = (str(tmp_path / n) for n in ("table", "updates", "chk"))
    for rows in ([message(0, 1.0, 0), message(1, 2.0, 0), message(2, 3.0, 1)], [message(3, 9.0, 1), message(4, 4.0, 2)]):
        send(rows)
        C.dual_sink(C.with_event_time(read(spark, path)), table, updates, chk, mode=None).awaitTermination()
    assert sorted(r.close for r in spark.read.parquet(table).collect()) == [1.0, 3.0, 4.0]
    sent = spark.read.parquet(updates)
    assert sent.count() == 5 and {r.topic for r in sent.collect()} == {"daily_eurusd"}


def test_publish_envelope(spark, topic, tmp_path):
    path, send = topic
    out = str(tmp_path / "out")
    send([message(0, 1.25)])
    C.publish(read(spark, path), out, str(tmp_path / "chk")).awaitTermination()
    row = spark.read.parquet(out).first()
    assert (row.type, row.ticker, row.partition) == ("price_update", "EURUSD", "1d_1m")
    assert json.loads(row.data)["close"] == 1.25


def test_latency_and_status(spark, topic, tmp_path):
    path, send = topic
    send([message(i, 1.0) for i in range(4)])
    late = F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, 0.25)")
    out = str(tmp_path / "o")
    q = C.to_table(C.consumed(C.with_event_time(read(spark, path)), late), out, str(tmp_path / "chk"))
    q.awaitTermination()
    rows = C.latency_rows(spark.read.parquet(out)).collect()
    assert [(r.messages, r.p50_ms, r.p99_ms) for r in rows] == [(4, 250, 250)]
    one = spark.createDataFrame([("a",), ("b",)], "ticker string")
    state = C.status(q, spark, "instant", one, one.limit(1), spark.read.parquet(out)).first()
    assert (state.status, state.input_rows, state.tickers, state.cached_tickers) == ("stopped", 4, 2, 1)


def test_status_counts_more_batches_than_a_query_remembers(spark, topic, tmp_path):
    path, send = topic
    for i in range(12):
        send([message(i, 1.0 + i)])
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")
    try:
        out = str(tmp_path / "o")
        q = C.land(C.from_files(spark, path), out, str(tmp_path / "chk"))
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert len(q.recentProgress) <= 6
    landed = spark.read.parquet(out)
    assert C.status(q, spark, "instant", landed, landed, landed).first().input_rows == 12


def test_latest_table_does_not_grow(spark, topic, tmp_path):
    path, send = topic
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    for i in range(5):
        send([message(i, 1.0 + i), message(100 + i, 9.0, minute=i, ticker="B")])
        C.keep_latest(read(spark, path), out, chk).awaitTermination()
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) <= 2
    assert {r.ticker: r.close for r in C.read_latest(spark, out).collect()} == {"EURUSD": 5.0, "B": 9.0}


def test_impossible_numbers_are_set_aside(spark, topic, tmp_path):
    path, send = topic
    send([message(0, 1.0), message(1, 1.0, volume="NaN"), message(2, 1.0, volume=1e30), message(3, "1,5"), message(4, "Infinity")])
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    C.quarantine(C.from_files(spark, path), good, bad, str(tmp_path / "chk")).awaitTermination()
    assert [r.offset for r in spark.read.parquet(good).collect()] == [0]
    assert sorted(r.offset for r in spark.read.parquet(bad).collect()) == [1, 2, 3, 4]


def test_online_features_prefer_instant_topics(spark):
    rows = [("a", (T0 + dt.timedelta(minutes=i)).isoformat(), "1m", topic, 0, i + base, *[price] * 4, 0)
            for topic, base, price in (("instant_a", 0, 1.0), ("daily_a", 1000, 999.0)) for i in range(30)]
    landed = spark.createDataFrame(rows, "ticker string, timestamp string, interval string, topic string, partition int, offset bigint, "
                                         "open double, high double, low double, close double, volume bigint")
    assert C.online_features(landed, ["Close"]).first().Close == 1.0
    assert C.online_features(landed.where("topic = 'daily_a'"), ["Close"]).first().Close == 999.0


def test_online_features_take_the_newest_candles(spark):
    rows = [("a", (T0 + dt.timedelta(minutes=i)).isoformat() + "Z", "1m", i, *[100.0 + (i % 9)] * 4, 0) for i in range(300)]
    rows.append(("a", "2030-01-01T00:00:00Z", "tick", 300, *[1.0] * 4, 0))
    landed = spark.createDataFrame(rows, "ticker string, timestamp string, interval string, offset bigint, open double, "
                                         "high double, low double, close double, volume bigint")
    got = C.online_features(landed, ["Close", "close_log_return_lag_1", "unknown"]).first()
    assert got.Close == 100.0 + 299 % 9 and got.unknown == 0.0
    assert got.ts == (T0 + dt.timedelta(minutes=299))
    oldest = C.online_features(landed, ["Close"], lookback=-240, newest=False).first()
    assert oldest.Close == 100.0 + 9 % 9


def test_message_features_equal_the_batch_rows(spark, topic, tmp_path):
    """In several runs from one checkpoint: a row per message, equal to the batch form on the messages up to it."""
    path, send = topic
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    names = [*S.training_features(), "unknown"]
    run = lambda: C.to_table(online.message_features(C.with_event_time(read(spark, path)), names), out, chk).awaitTermination()
    prices = {i: 100.0 + 7 * ((i * 37) % 11) + i / 100 for i in range(260)}
    prices[5] = 0.0  # no logarithm: its neighbours' returns are 0
    sent = [message(i, prices[i], ticker=t) for i in range(260) for t in ("A", "B") if t == "A" or i % 3 == 0]
    for part in (sent[:10], sent[10:11], sent[11:300]):
        send(part)
        run()
    # Two rows of one time, of which the later arrival counts, one that comes too late, and a tick.
    send([*sent[300:], message(900, 1.0, minute=260, ticker="A"), message(901, 2.0, minute=260, ticker="A"),
          message(902, 5.0, minute=3, ticker="A"), message(903, 5.0, minute=270, ticker="A", interval="tick")])
    run()
    got = {(r.ticker, r.offset): r for r in spark.read.parquet(out).collect()}
    assert set(got) == {(t, o) for t, _, _, _, o in sent} | {("A", 901)}
    rows = sorted(((t, o, v) for t, v, _, _, o in sent), key=lambda r: (r[0], r[1]))
    for ticker, last in (("A", 0), ("A", 1), ("A", 6), ("A", 61), ("A", 259), ("B", 3), ("B", 201), ("B", 258)):
        landed = [(t, v, o) for t, o, v in rows if t == ticker and o <= last]
        frame = topics.decode(spark.createDataFrame([(t, v, "instant_x", 0, o) for t, v, o in landed], topics.RECORD)).drop("payload")
        want = C.online_features(frame, names).first()
        for n in names:
            assert abs(got[(ticker, last)][n] - want[n]) < 1e-9 * max(1, abs(want[n])), (ticker, last, n)


def test_latency_by_buckets_over_many_batches(spark, topic, tmp_path):
    """Percentiles within the stated error of the exact ones, from counts alone; tables and tickers add up."""
    path, send = topic
    delays = {i: (i * 7919) % 50_000 for i in range(1200)}
    for k in range(12):
        send([message(i, 1.0, ticker="A" if i % 3 else "B") for i in range(100 * k, 100 * k + 100)])
    late = F.timestamp_millis(F.unix_millis("ts") + (F.col("offset") * 7919) % 50_000)
    out = str(tmp_path / "out")
    latency.keep_counts(C.consumed(C.with_event_time(read(spark, path)), late), out, str(tmp_path / "chk")).awaitTermination()
    counts = latency.read_counts(spark, out)
    assert counts.agg(F.sum("messages")).first()[0] == 1200 and counts.count() < 1200
    for keys, rows in ((("ticker",), latency.percentiles(counts)), ((), latency.percentiles(counts.unionByName(counts), ()))):
        for r in rows.collect():
            mine = sorted(d for i, d in delays.items() if not keys or r.ticker == ("A" if i % 3 else "B"))
            assert r.messages == len(mine) * (1 if keys else 2)
            for p, got in ((0.5, r.p50_ms), (0.95, r.p95_ms), (0.99, r.p99_ms)):
                exact = mine[-(-int(len(mine) * p * 100) // 100) - 1]
                assert exact * (1 - latency.ERROR) - 1 <= got <= exact
    few = spark.createDataFrame([(d,) for d in (-5, 0, 127, 128, 255, 256, 1_000_000)], "d bigint").select(latency.bucket(F.col("d")).alias("b"))
    assert [r.b for r in few.collect()] == [0, 0, 127, 128, 255, 256, 999424]


def test_slots_expire_by_themselves(spark, topic, tmp_path):
    path, send = topic
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    run = lambda: expiry.keep_changes(C.with_event_time(read(spark, path)), out, chk, seconds=90).awaitTermination()
    send([message(0, 1.0, 0), message(1, 2.0, 0, ticker="B"), message(2, 3.0, 1, ticker="B")])
    run()
    send([message(3, 5.0, 2, ticker="B"), message(4, 7.0, 0, ticker="B")])  # B goes on, A has no more
    run()
    changes = upkeep.Sink(spark, out).read()
    rows = sorted((r.ticker, r.offset, r.expired) for r in changes.collect())
    assert rows == [("B", 2, False), ("B", 3, False), ("EURUSD", 0, False), ("EURUSD", 0, True)]
    assert {(r.ticker, r.close) for r in expiry.alive(changes).collect()} == {("B", 5.0)}
    send([message(5, 9.0, 3), message(6, 1.0, 10, ticker="C")])  # A again; then time passes for both
    run()
    assert {r.ticker for r in expiry.alive(upkeep.Sink(spark, out).read()).collect()} == {"C"}


def test_hot_slot_keeps_one_row(spark):
    """A hundred thousand messages of a slot, taken chunk by chunk."""
    import pandas as pd

    n = 100_000
    part = pd.DataFrame({"ts": pd.Timestamp("2026-01-07") + pd.to_timedelta(range(n), unit="ms"), "topic": "t", "partition": 0, "offset": range(n), "close": 1.0})
    best = None
    for a in range(0, n, 10_000):
        best = expiry._newest(part.iloc[a:a + 10_000].iloc[::-1], best)
    assert best[3] == n - 1 and expiry._newest(part.iloc[:0], best) == best


def test_compaction_keeps_rows_and_bounds_files(spark, tmp_path):
    path = str(tmp_path / "sink")
    sink = upkeep.Sink(spark, path)

    def write(numbers):
        for n in numbers:
            spark.createDataFrame([(n, n % 3)], "n int, k int").coalesce(1).write.parquet(f"{path}/batch={n}")

    rows = lambda: sorted(r.n for r in sink.read().collect())
    write(range(12))
    before = sink.read()
    assert sink.compact() == 9 and rows() == list(range(12))
    assert sorted(r.n for r in before.collect()) == list(range(12))  # a reader that had begun
    assert sink.compact() is None
    write(range(12, 20))
    assert sink.compact() == 17 and rows() == list(range(20)) and sink.batches() == list(range(10, 20))
    write(range(20, 25))
    assert sink.compact(F.col("k") != 0) == 22
    assert rows() == [n for n in range(25) if n % 3 or n > 22]
    assert sink.merged() == [17, 22] and sink.batches() == list(range(18, 25))
    # The running query writes its last batch again.
    spark.createDataFrame([(24, 0)], "n int, k int").write.mode("overwrite").parquet(f"{path}/batch=24")
    assert rows() == [n for n in range(25) if n % 3 or n > 22]


def test_bounded_files_give_the_rows_of_one_batch(spark, monkeypatch):
    """Messages whose offsets do not follow their times, over many micro-batches: rows as from a single one."""
    from tapework.catalog import streams

    times = [T0 + dt.timedelta(minutes=(k * 37) % 500 // 2) for k in range(500)]
    made = spark.createDataFrame(
        [("t", k % 3, k, "AB"[k % 7 == 0], "1d", "1m", at.isoformat() + "Z", 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k % 11, 1) for k, at in enumerate(times)],
        "topic string, partition int, offset long, ticker string, period string, interval string, timestamp string,"
        " open double, high double, low double, close double, volume long")
    monkeypatch.setattr(streams, "messages", lambda *_: made)
    whole = sorted(map(repr, streams.stream_features(spark, None).collect()))
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    monkeypatch.setattr(streams, "PYTHON_FILES", 2)
    monkeypatch.setattr(online, "SLICE", 16)
    folders, kept = [], C.from_files
    monkeypatch.setattr(C, "from_files", lambda s, path, **more: folders.append((path, more)) or kept(s, path, **more))
    assert sorted(map(repr, streams.stream_features(spark, None).collect())) == whole
    (path, more), = folders
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert more == {"files_per_trigger": 2} and sum(sizes) == 500 and max(sizes) <= 150


def test_status_stages_messages_once(spark, monkeypatch):
    from tapework.catalog import streams

    calls, stage = [], streams.staged
    monkeypatch.setattr(streams, "staged", lambda *a, **more: calls.append(a) or stage(*a, **more))
    assert streams.stream_status(spark, "/root/testdata/sf0.001").count() == 1
    assert len(calls) == 1
