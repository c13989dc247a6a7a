"""Features against pandas, and freedom from look-ahead."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import frame, same
from tapework import schemas as S
from tapework.operators import features as X
from tapework.operators import splits


def grouped(walk):
    pdf = walk.sort_values(["ticker", "date"]).reset_index(drop=True)
    return pdf, pdf.groupby("ticker")


def test_ema_matches_recursion(walk, walk_df):
    got = frame(X.with_emas(X.positioned(walk_df)))
    pdf, _ = grouped(walk)
    for s in S.EMA_SPANS:
        want = pdf.groupby("ticker")["close"].transform(lambda c: c.ewm(span=s, adjust=False).mean())
        same(got[f"close_ema_{s}"], want, 1e-12)


def test_ema_across_blocks_with_a_long_series(spark):
    rng = np.random.default_rng(5)
    x = 50 + rng.normal(0, 1, 4000).cumsum()
    pdf = pd.DataFrame({"ticker": "a", "date": pd.date_range("2000-01-01", periods=4000).date, "close": x})
    df = spark.createDataFrame(pdf, "ticker string, date date, close double")
    got = frame(X.with_emas(X.positioned(df), spans=(5, 26)))
    for s in (5, 26):
        same(got[f"close_ema_{s}"], pdf["close"].ewm(span=s, adjust=False).mean(), 1e-12)


@pytest.mark.parametrize("block", [4, 512])
def test_ema_with_gaps_for_any_span(spark, block):
    rng = np.random.default_rng(9)
    values = np.where(rng.random(700) < 0.3, np.nan, 50 + rng.normal(0, 1, 700).cumsum())
    values[:2] = np.nan
    values[100:130] = np.nan
    pdf = pd.DataFrame({"ticker": "a", "date": pd.date_range("2000-01-01", periods=700).date, "close": values})
    rows = [(r.ticker, r.date, None if np.isnan(r.close) else float(r.close)) for r in pdf.itertuples()]
    df = spark.createDataFrame(rows, "ticker string, date date, close double")
    spans = (1, 2, 5, 26, 50, 200)
    got = frame(X.with_emas(X.positioned(df), spans=spans, block_rows=block))
    for s in spans:
        same(got[f"close_ema_{s}"], pdf["close"].ewm(span=s, adjust=False).mean(), 1e-10)
    known = spark.createDataFrame([("a", dt.date(2020, 1, k + 1), v) for k, v in enumerate([1.0, 2.0, None, 4.0, 5.0])], df.schema)
    same(frame(X.with_emas(X.positioned(known), spans=(5,)))["close_ema_5"], [1, 4 / 3, 4 / 3, 2.476190476, 3.317460317], 1e-8)


def test_serving_frame_fills_every_number(spark):
    rows = [("a", dt.date(2020, 1, k + 1), *[float(k + 1)] * 4, None if k % 2 else 5.0, None if k == 3 else k) for k in range(6)]
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, adj_close double, volume bigint")
    got = frame(X.inference_frame(bars))
    assert got["adj_close"].tolist() == [5.0] * 6 and got["volume"].tolist() == [0, 1, 2, 2, 4, 5]


def want_training(walk, lookback=200):
    out = []
    for ticker, g in walk.sort_values(["ticker", "date"]).groupby("ticker"):
        f = g[["ticker", "date", *S.PRICES]].copy()
        for p in S.PRICES:
            f[f"{p}_log"] = np.log(f[p])
            f[f"{p}_log_return"] = f[f"{p}_log"].diff()
        r = f["close_log_return"]
        f["target"] = r.shift(-1)
        for k in S.LAGS:
            f[f"close_log_return_lag_{k}"] = r.shift(k)
        for k in S.SHIFTED_WINDOWS:
            f[f"close_log_return_mean_{k}"] = r.shift(1).rolling(k).mean()
            f[f"close_log_return_std_{k}"] = r.shift(1).rolling(k).std()
        out.append(f.drop(columns="close_log_return").dropna())
    return pd.concat(out).sort_values(["ticker", "date"]).reset_index(drop=True)


def test_training_frame(small_blocks, walk, walk_df):
    got, want = frame(X.training_frame(walk_df)), want_training(walk)
    names = S.training_features()
    assert len(names) == 28 and got["date"].tolist() == want["date"].tolist()
    same(got[[*names, "target"]], want[[*names, "target"]])


def test_inference_frame_fills_instead_of_dropping(small_blocks, walk, walk_df):
    got = frame(X.inference_frame(walk_df))
    assert len(got) == len(walk) and not got.isna().any().any()
    for ticker, g in walk.sort_values(["ticker", "date"]).groupby("ticker"):
        mine = got[got["ticker"] == ticker]
        r = np.log(g["close"]).diff().fillna(0.0)
        same(mine["close_log_return"], r)
        same(mine["close_log_return_lag_20"], r.shift(20).ffill().bfill().fillna(0.0))
        same(mine["close_log_return_std_10"], r.shift(1).rolling(10).std().ffill().bfill().fillna(0.0))


def test_technical_frame(small_blocks, walk, walk_df):
    got = frame(X.technical_frame(walk_df))
    out = []
    for _, g in walk.sort_values(["ticker", "date"]).groupby("ticker"):
        f = g[["ticker", "date", *S.PRICES]].copy()
        f["close_log"] = np.log(f["close"])
        f["close_log_return"] = f["close_log"].diff()
        f["close_momentum_5"] = f["close"] - f["close"].shift(5)
        for k in S.MA_WINDOWS:
            f[f"close_ma_{k}"] = f["close"].rolling(k).mean()
        for s in S.EMA_SPANS:
            f[f"close_ema_{s}"] = f["close"].ewm(span=s, adjust=False).mean()
        for k in S.VOL_WINDOWS:
            f[f"close_log_return_vol_{k}"] = f["close_log_return"].rolling(k).std()
        f["high_low_range"] = f["high"] - f["low"]
        f["high_low_range_pct"] = f["high_low_range"] / f["low"]
        f["close_direction"] = np.sign(f["close_log_return"].fillna(0))
        f["target"] = f["close_log_return"].shift(-1)
        out.append(f.dropna())
    want = pd.concat(out).sort_values(["ticker", "date"])
    same(got[[*S.TECHNICAL_FEATURES, "target"]], want[[*S.TECHNICAL_FEATURES, "target"]])


def test_features_do_not_see_later_rows(small_blocks, walk, walk_df):
    cut = walk["date"].sort_values().iloc[len(walk) * 3 // 4]
    changed = walk_df.withColumns({p: F.when(F.col("date") > F.lit(cut), F.col(p) * 7).otherwise(F.col(p)) for p in S.PRICES})
    names = S.training_features()
    for make in (lambda d: X.inference_frame_raw(d).select("ticker", "date", *names),
                 lambda d: X.with_emas(X.positioned(d)).select("ticker", "date", "close_ema_5", "close_ema_26")):
        before, after = (frame(make(d).where(F.col("date") <= F.lit(cut))) for d in (walk_df, changed))
        same(before.drop(columns=["ticker", "date"]), after.drop(columns=["ticker", "date"]))


def test_sequences_count_and_content(small_blocks, walk, walk_df):
    got = X.sequences(walk_df, ["open", "close"], "close", 6, 2).toPandas().sort_values(["ticker", "date"])
    sizes = got.groupby("ticker").size()
    for ticker, n in walk.groupby("ticker").size().items():
        assert sizes.get(ticker, 0) == max(0, n - 6 - 2 + 1)
    g = walk[walk["ticker"] == "HOT"].sort_values("date")
    first = got[got["ticker"] == "HOT"].iloc[0]
    same(np.stack(first["x"]), g[["open", "close"]].iloc[:6])
    same(first["y"], g["close"].iloc[6:8])


def test_expanding_split_sizes(small_blocks, walk, walk_df):
    got = frame(splits.fold_sizes(walk_df), ["ticker", "fold"])
    for r in got.itertuples():
        n = (walk["ticker"] == r.ticker).sum()
        assert r.test_rows == n // 5 and r.train_rows == n - (4 - r.fold) * (n // 5)
    rows = frame(splits.expanding(walk_df), ["ticker", "fold", "date"])
    hot = rows[rows["ticker"] == "HOT"].groupby(["fold", "role"]).size().unstack()
    assert hot["test"].tolist() == [140] * 4 and hot["train"].tolist() == [140, 280, 420, 560]
    last_train = rows[(rows.ticker == "HOT") & (rows.role == "train")].groupby("fold")["date"].max()
    first_test = rows[(rows.ticker == "HOT") & (rows.role == "test")].groupby("fold")["date"].min()
    assert (last_train < first_test).all()


def test_walk_forward_drops_the_last_partial_block(small_blocks, walk, walk_df):
    got = frame(splits.walk_forward(walk_df))
    sizes = got.groupby(["ticker", "fold"]).size()
    assert (sizes == 25).all()
    assert got.groupby("ticker")["fold"].max().to_dict() == {"HOT": 19, "B": 3, "C": 1}


def test_min_history(walk_df):
    kept = {r.ticker for r in splits.min_history(walk_df).select("ticker").distinct().collect()}
    assert kept == {"HOT", "B", "C"}
