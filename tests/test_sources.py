"""Files, keyed tables, topics and validation."""

import datetime as dt
import zlib

import pytest
from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.functions import scalar as X
from tapework.operators import columns as C
from tapework.operators import quality
from tapework.sources import files, registry, tables, topics, versions

BAR = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume bigint"


def bar(ticker="EURUSD=X", day="2025-01-01", close=1.5):
    return (ticker, dt.date.fromisoformat(day), 1.0, 2.0, 0.9, close, close, 1000)


def bars(spark, *rows):
    return spark.createDataFrame(list(rows), BAR)


def test_csv_round_trip_finds_tickers_in_paths(spark, tmp_path):
    df = bars(spark, bar(), bar("4 NOT+SPEC%", "2025-01-02"), bar("A.B-C", "2025-02-03"))
    path = files.land_raw(df, str(tmp_path), "2025-03-01")
    got = files.read_raw(spark, path)
    assert got.columns == list(S.CANONICAL)
    assert sorted(got.collect()) == sorted(df.collect())


def test_landing_again_replaces_the_same_day_only(spark, tmp_path):
    files.land_raw(bars(spark, bar()), str(tmp_path), "2025-03-01")
    files.land_raw(bars(spark, bar(close=9.0)), str(tmp_path), "2025-03-01")
    path = files.land_raw(bars(spark, bar(day="2025-01-05")), str(tmp_path), "2025-03-02")
    assert sorted(r.close for r in files.read_raw(spark, path).collect()) == [1.5, 9.0]


def test_plain_raw_layout_and_default_ticker(spark, tmp_path):
    folder = tmp_path / "raw" / "EURUSD=X" / "ingest_date=2025-01-01"
    folder.mkdir(parents=True)
    header = "Date,Open,High,Low,Close,Adj Close,Volume\n"
    (folder / "f.csv").write_text(header + "2025-01-01,1,2,3,4,4,1000\n2025-01-02 00:00:00+00:00,1,2,3,oops,4,1000\n")
    got = files.read_raw(spark, str(tmp_path / "raw"), "FALLBACK").orderBy("date").collect()
    assert [r.ticker for r in got] == ["EURUSD=X"] * 2 and got[0].volume == 1000
    assert got[1].close is None and got[1].date == dt.date(2025, 1, 2)
    (tmp_path / "loose").mkdir()
    (tmp_path / "loose" / "g.csv").write_text(header + "2025-01-01,1,2,3,4,4,1000\n")
    assert files.read_raw(spark, str(tmp_path / "loose"), "FALLBACK").first().ticker == "FALLBACK"
    assert files.read_raw(spark, str(tmp_path / "loose")).first().ticker is None


def test_raw_files_with_other_headers(spark, tmp_path):
    """Columns by name, three names for the date, missing columns NULL, other columns dropped."""
    texts = {"A": "Close,Datetime,Low,High,Open,Extra\n4,2025-01-01 09:30:00,3,2,1,x\n", "B": "timestamp, HIGH ,close,Volume\n2025-01-02T00:00:00Z,7,8,1000.0\n",
             "C{1}": "Date,Open,High,Low,Close,Adj Close,Volume\n2025-01-03,1,2,3,4,5,1e3\n", "D": "a,b\n1,2\n"}
    for name, text in texts.items():
        folder = tmp_path / "raw" / name
        folder.mkdir(parents=True)
        (folder / "f.csv").write_text(text)
    got = {r.ticker: r for r in files.read_raw(spark, str(tmp_path / "raw")).collect()}
    assert set(got) == {"A", "B", "C{1}"}
    assert (got["A"].date, got["A"].open, got["A"].close, got["A"].volume) == (dt.date(2025, 1, 1), 1.0, 4.0, None)
    assert (got["B"].date, got["B"].high, got["B"].close, got["B"].open, got["B"].volume) == (dt.date(2025, 1, 2), 7.0, 8.0, None, 1000)
    assert (got["C{1}"].adj_close, got["C{1}"].volume) == (5.0, 1000)


def test_upsert_of_some_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_bars(bars(spark, bar(), bar("B", "2025-01-02")), path)
    some = spark.createDataFrame([("EURUSD=X", dt.date(2025, 1, 1), 9.0), ("NEW", dt.date(2025, 1, 1), 3.0)], "ticker string, date date, close double")
    tables.upsert_bars(some, path)
    got = {r.ticker: r for r in files.read_bars(spark, path).collect()}
    assert (got["EURUSD=X"].close, got["EURUSD=X"].high, got["EURUSD=X"].volume) == (9.0, 2.0, 1000)
    assert (got["NEW"].close, got["NEW"].high) == (3.0, None) and got["B"].close == 1.5


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tapework.session import shared_folder
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf={}, sparkContext=context))


def test_upsert_inserts_then_updates(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_bars(bars(spark, bar("OTHER", "2024-05-05"), bar("EURUSD=X", "2024-12-31")), path)
    tables.upsert_bars(bars(spark, bar()), path)
    tables.upsert_bars(bars(spark, bar(close=2.0)), path)
    tables.upsert_bars(bars(spark, bar(close=2.0)), path)
    got = {(r.ticker, str(r.date)): r.close for r in files.read_bars(spark, path).collect()}
    assert got == {("OTHER", "2024-05-05"): 1.5, ("EURUSD=X", "2024-12-31"): 1.5, ("EURUSD=X", "2025-01-01"): 2.0}
    assert files.read_bars(spark, path).count() == 3


def test_upsert_takes_the_latest_arrival_of_a_batch(spark):
    target = bars(spark, bar(close=1.0))
    batch = bars(spark, bar(close=2.0), bar(close=3.0)).withColumn("n", F.col("close"))
    assert [r.close for r in tables.upsert(target, batch, arrival="n").collect()] == [3.0]
    assert tables.insert_ignore(target, batch, arrival="n").count() == 0
    first = tables.insert_ignore(target.where("false"), batch, arrival="n")
    assert [r.close for r in first.collect()] == [2.0]


def test_rewriting_bars_does_not_duplicate(spark, tmp_path):
    path = str(tmp_path / "b")
    for _ in range(2):
        files.write_bars(bars(spark, bar(), bar(day="2025-01-02")), path)
    assert files.read_bars(spark, path).count() == 2


def test_normalize_and_date_fallback(spark):
    df = C.normalize_columns(spark.createDataFrame([("2025-01-01T10:00:00", 1.0)], "` Datetime ` string, `Adj Close` double"))
    assert df.columns == ["datetime", "adj_close"]
    assert C.with_date(df).first().date == dt.date(2025, 1, 1)
    with pytest.raises(ValueError):
        C.with_date(df.drop("datetime"))


def test_project_features_order_and_defaults(spark):
    df = spark.createDataFrame([("a", 1, "2.5", float("nan"))], "ticker string, date int, Open string, x double")
    got = C.project_features(df, ["x", "open", "none"]).first()
    assert (got.x, got.open, got.none) == (0.0, 2.5, 0.0)


def test_decode_accepts_both_spellings_and_keeps_bad_rows(spark):
    values = ['{"ticker":"EURUSD","close":1.0234,"timestamp":"2026-01-05T10:00:00"}',
              '{"ticker":"A","Close":2,"Open":"3","date":"2026-01-05","volume":7.0,"period":"5d","interval":"1h"}',
              "not json", '[1,2]', '{"close":1}', '{"ticker":"","timestamp":"x"}']
    df = spark.createDataFrame([("k", v, "t", 0, i) for i, v in enumerate(values)], topics.RECORD)
    got = topics.decode(df).orderBy("offset").collect()
    assert (got[0].ticker, got[0].close, got[0].open, got[0].period, got[0].interval) == ("EURUSD", 1.0234, 0.0, "1d", "1m")
    assert (got[1].open, got[1].close, got[1].volume, got[1].timestamp, got[1].interval) == (3.0, 2.0, 7, "2026-01-05", "1h")
    assert [r.ticker for r in got[2:]] == [None] * 4
    assert topics.well_formed(topics.decode(df)).count() == 2


def test_topic_partition_matches_checksum(spark):
    for key in ("EURUSD=X", "GBPUSD=X", "x"):
        got = spark.range(1).select(X.topic_partition(F.lit(key)).alias("p")).first().p
        assert got == zlib.crc32(key.encode()) % 16
    assert zlib.crc32(b"EURUSD=X") % 16 == 15


def test_bounded_reads(small_blocks, spark):
    df = spark.createDataFrame([("a", i) for i in range(100)] + [("b", i) for i in range(5)], "ticker string, offset bigint")
    for newest, want in ((True, list(range(90, 100))), (False, list(range(10)))):
        got = topics.bounded_read(df, 10, newest)
        assert sorted(r.offset for r in got.where("ticker = 'a'").collect()) == want
        assert got.where("ticker = 'b'").count() == 5
    assert topics.latest_read(df, 500).where("ticker = 'a'").count() == 50


def test_validation_rows(spark):
    good = bars(spark, bar(day="2025-01-01"), bar(day="2025-01-02"))
    rules = {r.rule: r.passed for r in quality.validate(good, good, good).collect()}
    assert len(rules) == 7 and all(rules.values())
    bad = bars(spark, bar(day="2025-01-01"), bar(day="2025-01-09", close=None))
    rules = {r.rule: r.passed for r in quality.validate(good.limit(1), good, bad, min_rows=3).collect()}
    assert [k for k, v in rules.items() if not v] == ["min_rows", "processed_within_raw", "not_null_close", "continuity"]
    with pytest.raises(AssertionError, match="continuity"):
        quality.enforce(quality.validate(good, good, bad))


def test_registry_round_trip(spark, tmp_path):
    best = spark.createDataFrame([("USDCHF=X", 3, .003, .004, .59, .71, 8.13211, -.0353, .71, "Exceptional")],
                                 "ticker string, fold bigint, mae double, rmse double, ic double, dir_acc double, "
                                 "sharpe double, max_dd double, hit_rate double, performance string")
    registry.write(registry.records(best, S.training_features()), str(tmp_path / "r"))
    got = registry.summary(registry.read_lines(spark, str(tmp_path / "r"))).first()
    assert (got.symbol, got.name, got.accuracy, got.sharpe) == ("USDCHF=X", "US Dollar / Swiss Franc", 71.0, 8.13)
    nested = tmp_path / "models" / "USDCHF=X"
    nested.mkdir(parents=True)
    (nested / "metadata.json").write_text('{\n "ticker": "USDCHF=X",\n "features": ["Open", "Close"],\n "metrics": {"ic": 0.5}\n}')
    row = registry.read(spark, str(tmp_path / "models")).first()
    assert row.features == ["Open", "Close"] and row.metrics.ic == 0.5


def test_points_kept(spark):
    # Fixed values: (period, interval, points).
    cases = [("1d", "5m", 288), ("5d", "1m", 6000), ("1mo", "1h", 720), ("1y", "1d", 400), ("1mo", "1d", 40),
             ("zz", "5m", 2000), ("1d", "tick", 2000), (None, None, 2000), ("5d", "xm", 6000)]
    got = spark.createDataFrame(cases, "p string, i string, want int").select(
        X.max_points(F.col("p"), F.col("i")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_limits_above_the_bound_raise(small_blocks, spark):
    from tapework.operators import series
    df = spark.createDataFrame([("a", i) for i in range(20)], "ticker string, offset bigint")
    with pytest.raises(Exception, match="above the bound"):
        series.tail(df, ["ticker"], ["offset"], F.lit(9), most=5).collect()


def test_time_parsing(spark):
    cases = [("2026-01-07T10:00:00Z", 1767780000000), ("2026-01-07 10:00:00+00:00", 1767780000000),
             ("2026-01-07T10:00:00", 1767780000000), ("2026-01-07", 1767744000000), ("junk", None), ("", None),
             ("2026-01-07T12:00:00+02:00", 1767780000000)]
    got = spark.createDataFrame(cases, "s string, want bigint").select(X.epoch_millis(F.col("s")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_other_ways_to_write_a_time(spark):
    cases = {"Jan 5 2025 10:00": "2025-01-05 10:00:00", "05/01/2025": "2025-05-01 00:00:00", "Sun, 5 Jan 2025 10:00:00 +0200": "2025-01-05 08:00:00",
             "20250105": "2025-01-05 00:00:00", "10:00": None, "5 January": None, "2025-01-05T10:00:00.5Z": "2025-01-05 10:00:00.5"}
    got = spark.createDataFrame(list(cases.items()), "s string, want string").select(
        "s", X.parse_timestamp(F.col("s")).alias("got"), F.col("want").cast("timestamp").alias("want")).collect()
    assert {r.s: r.got for r in got} == {r.s: r.want for r in got}


def test_versions_change_at_one_point(spark, tmp_path, monkeypatch):
    """A reader sees the old table or the new one; a writer that fails half way leaves the old one."""
    path = str(tmp_path / "table")
    tables.upsert_versioned(bars(spark, bar(), bar("GBP", "2024-05-01")), path)
    old = tables.read_versioned(spark, path)
    assert tables.upsert_versioned(bars(spark, bar(close=2.0)), path) == 2
    closes = lambda df: {(r.ticker, r.close) for r in df.collect()}
    first, new = closes(old), closes(tables.read_versioned(spark, path))
    assert len(first) == len(new) == 2 and len(first & new) == 1 and any(c == 2.0 for _, c in new)
    assert closes(tables.read_versioned(spark, path, 1)) == first

    def killed(self, version):
        raise KeyboardInterrupt
    monkeypatch.setattr(versions.Versions, "_point", killed)
    with pytest.raises(KeyboardInterrupt):
        tables.upsert_versioned(bars(spark, bar(close=9.0)), path)
    monkeypatch.undo()
    assert closes(tables.read_versioned(spark, path)) == new
    assert tables.upsert_versioned(bars(spark, bar(close=3.0)), path) == 3
    assert any(c == 3.0 for _, c in closes(tables.read_versioned(spark, path)))


def test_versions_take_one_writer_and_forget_old_ones(spark, tmp_path):
    path = str(tmp_path / "table")
    for k in range(4):
        tables.upsert_versioned(bars(spark, bar(close=float(k)), *([bar("007", close=0.0)] if k == 0 else [])), path)
    table = versions.Versions(spark, path, ["ticker", "year"])
    with pytest.raises(versions.Conflict):
        table.replace(table.read(), base=2)
    assert table.latest() == 4 and table.committed() == [1, 2, 3, 4]
    claim = tmp_path / "table" / "claims" / "000000000005"
    claim.touch()  # a writer that was killed, or is still running
    with pytest.raises(versions.Conflict):
        tables.upsert_versioned(bars(spark, bar(close=8.0)), path)
    table.release()
    assert tables.upsert_versioned(bars(spark, bar(close=8.0)), path) == 5
    before = sorted((r.ticker, r.close) for r in tables.read_versioned(spark, path).collect())
    assert before == [("007", 0.0), ("EURUSD=X", 8.0)]
    assert table.vacuum(keep=1) == [2, 3, 4]
    assert sorted((r.ticker, r.close) for r in tables.read_versioned(spark, path).collect()) == before
    assert len([p for p in (tmp_path / "table" / "data").iterdir() if p.name.startswith("version=")]) == 2


def test_empty_batch_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.upsert_versioned(bars(spark, bar()), path)
    tables.upsert_versioned(bars(spark, bar()).limit(0), path)
    assert tables.read_versioned(spark, path).count() == 1
