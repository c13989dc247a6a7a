"""Fits from summed cross products against direct numpy fits, statistics and joins."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import frame, same
from tapework import schemas as S
from tapework.operators import features, joins, model, ranking, resample, splits, stats


@pytest.fixture(scope="module")
def lagged(spark, walk_df):
    return model.lag_frame(walk_df).cache()


def series_of(pdf, ticker):
    return pdf[pdf["ticker"] == ticker].sort_values("date")


def test_line_per_expanding_fold(small_blocks, lagged):
    got, pdf = frame(model.ols1_forecast(lagged), ["ticker", "fold", "date"]), lagged.toPandas()
    for ticker in ("HOT", "B"):
        g = series_of(pdf, ticker)
        size = len(g) // 5
        for fold in range(4):
            start = len(g) - (4 - fold) * size
            slope, cut = np.polyfit(g["x"][:start], g["y"][:start], 1)
            mine = got[(got.ticker == ticker) & (got.fold == fold)]
            same(mine["pred"], slope * g["x"][start:start + size] + cut, 1e-8)
            same(mine["actual"], g["y"][start:start + size])


def test_line_per_walk_forward_step(small_blocks, lagged):
    got, pdf = frame(model.walk_forward_forecast(lagged), ["ticker", "fold", "date"]), lagged.toPandas()
    g = series_of(pdf, "HOT")
    mine = got[got.ticker == "HOT"]
    assert mine["fold"].max() == (len(g) - 225) // 25
    for fold in (0, 1, 7, mine["fold"].max()):
        start = 200 + 25 * fold
        slope, cut = np.polyfit(g["x"][:start], g["y"][:start], 1)
        same(mine[mine.fold == fold]["pred"], slope * g["x"][start:start + 25] + cut, 1e-8)


def test_standardize_uses_training_rows_only(small_blocks, walk, walk_df):
    got = frame(model.standardize(walk_df.select("ticker", "date", "close"), ["close"]), ["ticker", "fold", "date"])
    g = series_of(walk, "B")["close"].to_numpy()
    size = len(g) // 5
    for fold in range(4):
        start = len(g) - (4 - fold) * size
        want = (g[start:start + size] - g[:start].mean()) / g[:start].std()
        same(got[(got.ticker == "B") & (got.fold == fold)]["close"], want, 1e-8)


def test_ridge_matches_direct_solution(small_blocks, spark, walk_df):
    frame_df = features.training_frame(walk_df, lookback=20).cache()
    names = S.training_features(20)
    got = frame(model.ridge_forecast(frame_df, names, strength=2.0), ["ticker", "fold", "date"])
    pdf = frame_df.toPandas()
    g = series_of(pdf, "HOT")
    x, y, size = g[names].to_numpy(), g["target"].to_numpy(), len(g) // 5
    for fold in (0, 3):
        start = len(g) - (4 - fold) * size
        m, s = x[:start].mean(0), x[:start].std(0)
        z = (x - m) / s
        w = np.linalg.solve(z[:start].T @ z[:start] + 2.0 * np.eye(len(names)), z[:start].T @ (y[:start] - y[:start].mean()))
        want = z[start:start + size] @ w + y[:start].mean()
        same(got[(got.ticker == "HOT") & (got.fold == fold)]["pred"], want, 1e-6)
    sweep = model.param_sweep(frame_df, names, [0.1, 2.0])
    row = sweep.where("ticker = 'HOT' and fold = 3 and trial = 1").first()
    p, a = want, y[start:start + size]
    mape = np.mean(np.abs(a - p) / np.maximum(np.abs(a), 2.220446049250313e-16))
    r2 = 1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum()
    loss = 0.4 * mape + 0.4 * (1 - r2) + 0.2 * np.abs(a - p).mean() / np.abs(a).mean()
    same(row.loss, loss, 1e-5)


def test_gram_flushes_many_keys(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.integers(0, 40, 900), "a": rng.normal(size=900), "b": rng.normal(size=900)})
    got = stats.gram(spark.createDataFrame(pdf), ["k"], ["a", "b"], flush=3).toPandas()
    for k, g in pdf.groupby("k"):
        x = np.column_stack([np.ones(len(g)), g[["a", "b"]]])
        cells = got[got.k == k]
        same([cells[(cells.i == i) & (cells.j == j)]["s"].iloc[0] for i in range(3) for j in range(i, 3)],
             [(x.T @ x)[i, j] for i in range(3) for j in range(i, 3)])


def adf_direct(y):
    """Textbook regression with the lag chosen by AIC on shared rows."""
    n = len(y)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(y)

    def fit(p, first):
        rows = np.arange(first, n - 1)
        x = np.column_stack([np.ones(len(rows)), y[rows], *[d[rows - k] for k in range(1, p + 1)]])
        b, *_ = np.linalg.lstsq(x, d[rows], rcond=None)
        e = d[rows] - x @ b
        cov = np.linalg.inv(x.T @ x) * (e @ e) / (len(rows) - x.shape[1])
        return b[1] / np.sqrt(cov[1, 1]), len(rows) * (np.log(2 * np.pi * (e @ e) / len(rows)) + 1) + 2 * x.shape[1], len(rows)

    best = min(range(top + 1), key=lambda p: fit(p, top)[1])
    return fit(best, best)[0], best, fit(best, best)[2]


def test_unit_root(small_blocks, walk, walk_df):
    got = frame(stats.adf_test(walk_df), ["ticker"]).set_index("ticker")
    assert "TINY" not in got.index
    for ticker in ("HOT", "B", "C"):
        y = np.diff(np.log(series_of(walk, ticker)["close"].to_numpy()))
        stat, lag, n = adf_direct(y)
        same(got.loc[ticker, "adf_stat"], stat, 1e-6)
        assert (got.loc[ticker, "used_lag"], got.loc[ticker, "nobs"]) == (lag, n)
        assert got.loc[ticker, "stationary"] == "Yes"


def test_published_p_value():
    assert stats.p_value(-14.318173) == pytest.approx(1.153328e-26, rel=1e-4)


def test_correlation_and_density(small_blocks, walk, walk_df):
    returns = walk_df.select("ticker", "date", F.col("close").alias("close_log_return"))
    got = {(r.a, r.b): (r.n, r["corr"]) for r in stats.cross_correlation(returns, block_days=30).collect()}
    wide = walk.pivot(index="date", columns="ticker", values="close")
    for a, b in (("B", "HOT"), ("B", "C"), ("C", "HOT")):
        both = wide[[a, b]].dropna()
        assert got[(a, b)][0] == len(both)
        same(got[(a, b)][1], both[a].corr(both[b]), 1e-7)
    tiled = {(r.a, r.b): (r.n, r["corr"]) for r in stats.cross_correlation(returns, block_days=30, tile=1).collect()}
    assert tiled.keys() == got.keys() and all(tiled[k][0] == got[k][0] and abs(tiled[k][1] - got[k][1]) < 1e-9 for k in got if got[k][1] is not None)
    curve = frame(stats.density_curve(walk_df.where("ticker = 'B'")), ["point"])
    v = series_of(walk, "B")["close"].to_numpy()
    bw = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 200)
    same(curve["x"], x)
    same(curve["density"], np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * np.sqrt(2 * np.pi)))


def test_histogram_edges(spark):
    v = np.concatenate([np.linspace(-1, 1, 101), [1.0, 1.0]])
    got = frame(stats.histogram(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", 50), ["bin"])
    assert got["rows"].sum() == len(v) and got["bin"].max() == 50
    assert got["rows"].iloc[-1] >= 3


# Live values over history: exact slot, any slot, none.
def test_live_override(spark):
    history = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 1.055), ("B", 1, 2.0), ("C", 1, 3.0)], "ticker string, date int, close double")
    live = spark.createDataFrame([("A", "1d", "5m", 1.1, 5), ("A", "1d", "1m", 9.9, 1), ("B", "5d", "1h", 2.2, 2), ("B", "1mo", "1d", 8.8, 3)],
                                 "ticker string, period string, interval string, close double, received int")
    got = {r.ticker: r.latest_price for r in joins.live_override(history, live, "1d", "5m").collect()}
    assert got == {"A": 1.1, "B": 2.2, "C": 3.0}


def test_first_available_source(spark):
    rows = spark.createDataFrame([("A", 2, 1), ("A", 1, 2), ("A", 1, 3), ("B", 2, 4)], "ticker string, p int, v int")
    got = sorted((r.ticker, r.v) for r in ranking.first_available(rows, ["ticker"], F.col("p")).collect())
    assert got == [("A", 2), ("A", 3), ("B", 4)]


def test_outcomes_keep_errors_as_rows(spark):
    one = lambda *t: spark.createDataFrame([(x,) for x in t], "ticker string")
    scores = spark.createDataFrame([("A", -0.0030951)], "ticker string, pred double")
    got = {r.ticker: r for r in joins.batch_outcomes(one("A", "B", "Z"), one("A", "B"), scores).collect()}
    assert (got["A"].predicted_log_return, got["A"].direction, got["A"].error) == (-0.003095, "DOWN", None)
    assert got["B"].error == "Features not available" and got["Z"].error == "Unsupported ticker"


def test_candles_hold_their_prices(spark):
    rows = [("a", f"2024-01-01 10:{m:02d}:30", i, float((i * 7) % 5 + 1)) for i, m in enumerate(range(0, 60, 2))]
    df = spark.createDataFrame(rows, "ticker string, t string, seq bigint, price double").withColumn("ts", F.to_timestamp("t"))
    got = frame(resample.resample(df, "7m"), ["bucket"])
    assert [b.minute for b in got["bucket"]] == [0, 7, 14, 21, 28, 35, 42, 49, 56]
    assert ((got.low <= got.open) & (got.open <= got.high) & (got.low <= got.close) & (got.close <= got.high)).all()
    assert got["volume"].sum() == 30


def dot_model(weights):
    """Smallest model file for onnxruntime: one matrix product, encoded by hand."""
    def field(number, data, wire=2):
        def varint(n):
            out = b""
            while n > 127:
                out, n = out + bytes([n & 127 | 128]), n >> 7
            return out + bytes([n])
        head = varint(number << 3 | wire)
        return head + (varint(data) if wire == 0 else varint(len(data)) + data)

    n = len(weights)

    def value(name, rows, cols):
        dims = b"".join(field(1, field(1, d, 0) if d else field(2, b"n")) for d in (rows, cols))
        return field(1, name) + field(2, field(1, field(1, 1, 0) + field(2, dims)))

    tensor = field(1, n, 0) + field(1, 1, 0) + field(2, 1, 0) + field(8, b"w") + field(9, np.asarray(weights, "<f4").tobytes())
    node = field(1, b"x") + field(1, b"w") + field(2, b"y") + field(4, b"MatMul")
    graph = field(1, node) + field(2, b"g") + field(5, tensor) + field(11, value(b"x", 0, n)) + field(12, value(b"y", 0, 1))
    return field(1, 8, 0) + field(7, graph) + field(8, field(1, b"") + field(2, 13, 0))


def test_model_files_are_scored_per_ticker(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    for ticker, w in (("A", [1.0, 2.0]), ("B", [-1.0, 0.5])):
        (tmp_path / ticker).mkdir()
        (tmp_path / ticker / "model.onnx").write_bytes(dot_model(w))
    rows = spark.createDataFrame([("A", 1.0, 2.0), ("B", 4.0, 2.0), ("A", 0.0, 1.0)], "ticker string, p double, q double")
    got = model.loaded_score(rows.repartition(2), ["p", "q"], model.OnnxModels(str(tmp_path))).collect()
    assert sorted((r.ticker, r.p, r.pred) for r in got) == [("A", 0.0, 2.0), ("A", 1.0, 5.0), ("B", 4.0, -3.0)]


def test_moments_of_large_values_keep_their_spread(spark):
    """Values near 1e8 with a deviation of 0.1, whose squares have no digits left for it."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"ticker": "a", "date": pd.date_range("2000-01-01", periods=500).date, "x": 1e8 + rng.normal(0, 0.1, 500)})
    df = spark.createDataFrame(pdf, "ticker string, date date, x double")
    got = model.train_stats(splits.with_segments(df), ["x"]).orderBy("fold").collect()
    for r in got:
        train = pdf["x"][: 500 - (4 - r.fold) * 100]
        assert abs(r.x_std - train.std(ddof=0)) < 1e-6 and abs(r.x_mean - train.mean()) < 1e-5
