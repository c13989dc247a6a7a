"""Backtests against numpy, and the published summary numbers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import frame, same
from tapework.functions import scalar as X
from tapework.operators import backtest, ranking


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(11)
    parts = []
    for ticker, n in (("HOT", 300), ("B", 40), ("FLAT", 20)):
        for fold in (0, 1):
            pred = rng.normal(0, 0.01, n) * (rng.random(n) > 0.1)
            pred[rng.random(n) < 0.1] *= 1e-5
            parts.append(pd.DataFrame({
                "ticker": ticker, "fold": fold, "date": pd.date_range("2020-01-01", periods=n).date,
                "pred": 0.0 if ticker == "FLAT" else pred, "actual": np.round(rng.normal(0, 0.01, n), 3)}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf, "ticker string, fold bigint, date date, pred double, actual double").cache()


def expected(g, convention):
    pos = np.sign(g["pred"].to_numpy())
    if convention == "turnover":
        pos = np.where(np.abs(g["pred"]) < 1e-5, 0.0, pos)
    change = np.diff(pos, prepend=0)
    cost = (change != 0) * 0.0001 if convention == "flat" else np.abs(change) * 0.0001
    net = pos * g["actual"].to_numpy() - cost
    cum = np.cumsum(net)
    top = np.maximum.accumulate(cum)
    std = net.std()
    sharpe = net.mean() / std * np.sqrt(252) if std > 0 else (0.0 if convention == "flat" else np.nan)
    sign = np.sign(g["pred"]) == np.sign(g["actual"])
    return {"net": net, "cum": cum, "sharpe": sharpe, "net_pnl": net.sum(),
            "max_dd": (cum - top).min() if convention == "flat" else (top - cum).max(),
            "hit_rate": (net > 0).mean() if convention == "flat" else sign.mean(), "dir_acc": sign.mean()}


@pytest.mark.parametrize("convention", ["flat", "turnover"])
def test_report(small_blocks, made, convention):
    pdf, df = made
    got = frame(backtest.report(df, convention), ["ticker", "fold"]).set_index(["ticker", "fold"])
    cum = frame(backtest.cumulative(df, convention), ["ticker", "fold", "date"])
    for (ticker, fold), g in pdf.groupby(["ticker", "fold"]):
        want, row = expected(g, convention), got.loc[(ticker, fold)]
        for name in ("sharpe", "max_dd", "hit_rate", "net_pnl"):
            same(row[name], want[name])
        rows = cum[(cum.ticker == ticker) & (cum.fold == fold)]
        same(rows["net"], want["net"])
        same(rows["cum"], want["cum"])
        if convention == "flat":
            ic = g["pred"].rank().corr(g["actual"].rank()) if g["pred"].nunique() > 1 else np.nan
            same(row["ic"], ic)
            same(row["mae"], (g["actual"] - g["pred"]).abs().mean())
        else:
            same(row["ic"], g["pred"].corr(g["actual"]) if g["pred"].nunique() > 1 else np.nan)
    if convention == "flat":
        assert set(got.loc["FLAT"]["performance"]) == {"Weak"}


def test_equity_per_ticker_and_over_everything(small_blocks, made):
    pdf, df = made
    nets = pdf.sort_values(["ticker", "fold", "date"]).groupby(["ticker", "fold"], group_keys=False).apply(
        lambda g: pd.Series(expected(g, "turnover")["net"], index=g.index))
    order = pdf.sort_values(["ticker", "fold", "date"]).index
    own = frame(backtest.equity(df), ["ticker", "fold", "date"])
    whole = frame(backtest.equity(df, as_is=True), ["ticker", "fold", "date"])
    same(own["equity"], nets.loc[order].groupby(pdf.loc[order, "ticker"].values).cumsum())
    same(whole["equity"], nets.loc[order].cumsum())


# Published fold results: mae, rmse, ic, dir_acc, sharpe, max_dd, hit_rate, grade.
FOLDS = {
    "EURUSD=X": [
        (0.006393, 0.011325, 0.000590, 0.498478, 0.472972, -0.292600, 0.495434, "Weak"),
        (0.005299, 0.007180, 0.022002, 0.509132, -0.040226, -0.228496, 0.503805, "Weak"),
        (0.003104, 0.004059, 0.418234, 0.632420, 5.663345, -0.027410, 0.629376, "Exceptional"),
        (0.002734, 0.003853, 0.588114, 0.717656, 7.902904, -0.027104, 0.712329, "Exceptional")],
    "AUDUSD=X": [
        (0.009202, 0.069627, None, 0.121005, 0.000000, 0.000000, 0.000000, "Weak"),
        (0.023711, 0.040758, -0.017032, 0.511416, 0.299722, -0.137254, 0.508371, "Weak"),
        (0.008764, 0.015186, 0.130517, 0.564688, 1.889675, -0.148392, 0.562405, "Exceptional"),
        (0.005449, 0.009973, 0.437082, 0.668189, 6.269305, -0.051218, 0.665145, "Exceptional")],
    "USDCHF=X": [
        (0.005938, 0.008284, 0.003248, 0.492390, -0.197627, -0.365706, 0.487062, "Weak"),
        (0.005435, 0.009041, 0.111200, 0.541857, 0.807028, -0.249960, 0.538813, "Acceptable"),
        (0.002575, 0.003413, 0.560706, 0.683409, 7.194844, -0.036073, 0.678082, "Exceptional"),
        (0.002962, 0.004127, 0.590817, 0.719178, 8.132212, -0.035301, 0.712329, "Exceptional")],
    "RUBUSD=X": [
        (0.004380, 0.008597, 0.013141, 0.442161, 0.302682, -0.220769, 0.437595, "Weak"),
        (0.009103, 0.013911, -0.026467, 0.476408, -1.073972, -1.217463, 0.476408, "Weak"),
        (0.012580, 0.181018, 0.537824, 0.678082, 0.301622, -4.626032, 0.672755, "Marginal"),
        (0.070489, 0.132585, 0.055620, 0.505327, 0.332880, -2.719900, 0.503805, "Marginal")],
}
# Published averages: mae, rmse, ic, dir_acc, sharpe, max_dd, hit_rate, grade, and rank among these four.
OVERALL = {
    "EURUSD=X": (0.004382, 0.006604, 0.257235, 0.589422, 3.499749, -0.143902, 0.585236, "Exceptional", 2),
    "AUDUSD=X": (0.011782, 0.033886, 0.183522, 0.466324, 2.114675, -0.084216, 0.433980, "Weak", 3),
    "USDCHF=X": (0.004227, 0.006216, 0.316493, 0.609209, 3.984114, -0.171760, 0.604072, "Exceptional", 1),
    "RUBUSD=X": (0.024138, 0.084028, 0.145029, 0.525495, -0.034197, -2.196041, 0.522641, "Weak", 4),
}


@pytest.fixture(scope="module")
def published(spark):
    rows = [(t, i, *f) for t, folds in FOLDS.items() for i, f in enumerate(folds)]
    return spark.createDataFrame(rows, "ticker string, fold bigint, mae double, rmse double, ic double, dir_acc double, "
                                       "sharpe double, max_dd double, hit_rate double, performance string")


def test_published_grades(published):
    graded = published.withColumn("g", X.grade_model(F.col("ic"), F.col("dir_acc"), F.col("sharpe")))
    assert graded.where("g <> performance").count() == 0


def test_published_averages_and_ranking(published):
    for r in ranking.rank_by(ranking.overall_summary(published), "avg_sharpe").collect():
        want = OVERALL[r.ticker]
        same([r[f"avg_{c}"] for c in ranking.AVERAGED], want[:7], 2e-6)
        assert (r.status, r.rank) == want[7:]


def test_best_model_gate(published):
    best = {r.ticker: r.fold for r in ranking.best_model(published).collect()}
    assert best == {"EURUSD=X": 3, "AUDUSD=X": 3, "USDCHF=X": 3}


def test_first_fold_wins_a_tie(spark):
    rows = spark.createDataFrame([("a", 2, 0.5, 3.0), ("a", 1, 0.5, 3.0), ("a", 0, 0.01, 9.0)],
                                 "ticker string, fold bigint, ic double, sharpe double")
    assert ranking.best_model(rows).first().fold == 1


def test_regression_grades(spark):
    rows = spark.createDataFrame([(0.8, 1.0), (0.8, 7.0), (0.4, 12.0), (0.9, 99.0), (None, 1.0)], "r2 double, mape double")
    got = [r.g for r in rows.select(X.grade_regression(F.col("r2"), F.col("mape")).alias("g")).collect()]
    assert got == ["Excellent", "Good", "Moderate", "Poor", "Poor"]
