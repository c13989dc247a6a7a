"""Boosted trees, refits and window models against plain numpy."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from conftest import frame, same
from tapework import schemas as S
from tapework.operators import features, refits, trees
from tapework.operators.trees import BINS, GRID, Settings

QUICK = Settings(leaves=6, rate=0.3, least=5, rounds=8, patience=50)


def steps(n, seed, ticker="a", scale=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[::17, 2] = np.nan
    y = scale * (np.sign(x[:, 0]) + 0.5 * (x[:, 1] > 0.3) + rng.normal(0, 0.2, n))
    return pd.DataFrame({"ticker": ticker, "date": pd.date_range("2015-01-01", periods=n).date, "x": x[:, 0], "z": x[:, 1], "gap": x[:, 2], "target": y})


SCHEMA = "ticker string, date date, x double, z double, gap double, target double"
NAMES = ["x", "z", "gap"]


def plain_boost(pdf, fold, s, n_splits=4, holdout=0.1):
    """The same booster with a histogram per leaf and feature by loops: predictions of the fold's test
    rows and the best round."""
    n = len(pdf)
    size = n // (n_splits + 1)
    end = n - (n_splits - fold) * size
    late = end - int(np.floor(end * holdout))
    first = n - n_splits * size
    y = pdf["target"].to_numpy()
    mean, std = y[:end].mean(), y[:end].std()
    q = np.rint((y - mean) / std * GRID).astype(int)
    bins = []
    for c in NAMES:
        v = pdf[c].to_numpy()
        known = np.sort(v[:first][~np.isnan(v[:first])])
        cuts = sorted({known[max(0, int(np.ceil(k / BINS * len(known))) - 1)] for k in range(1, BINS)})
        bins.append([0 if np.isnan(a) else sum(a > c for c in cuts) for a in v])
    bins = np.array(bins).T
    pred = np.zeros(n, int)
    best, best_round, best_loss = pred.copy(), 0, int(((q - pred)[late:end] ** 2).sum())
    for k in range(s.rounds):
        cols = trees.drawn(len(NAMES), s, k)
        bag = trees.in_bag(np.arange(n), s, k) & (np.arange(n) < late)
        leaf = np.zeros(n, int)
        res = q - pred
        leaves = 1

        def best_of(leaf_id):
            rows = np.nonzero(bag & (leaf == leaf_id))[0]
            found = None
            total = res[rows].sum()
            for f in cols:
                for b in range(BINS - 1):
                    left = rows[bins[rows, f] <= b]
                    m = len(left)
                    if m < s.least or len(rows) - m < s.least:
                        continue
                    g = res[left].sum()
                    gain = g * float(g) / m + (total - g) * float(total - g) / (len(rows) - m) - total * float(total) / len(rows)
                    if found is None or gain > found[0]:
                        found = (gain, f, b)
            return found if found and found[0] > 1e-9 * max(1.0, total * float(total) / len(rows)) else None

        open_ = {0: best_of(0)}
        while leaves < s.leaves and any(open_.values()):
            at = min((g for g in open_ if open_[g]), key=lambda g: (-open_[g][0], g))
            _, f, b = open_[at]
            leaf[(leaf == at) & (bins[:, f] > b)] = leaves
            open_[at], open_[leaves] = best_of(at), best_of(leaves)
            leaves += 1
        if leaves == 1:
            continue
        for i in range(leaves):
            rows = bag & (leaf == i)
            pred[leaf == i] += int(round(s.rate * res[rows].sum() / rows.sum()))
        loss = int(((q - pred)[late:end] ** 2).sum())
        if loss < best_loss:
            best, best_round, best_loss = pred.copy(), k + 1, loss
        if k + 1 - best_round >= s.patience:
            break
    return best[end:end + size] / GRID * std + mean, best_round


def test_boosting_equals_plain_numpy(spark):
    parts = [steps(180, 1), steps(140, 2, "b")]
    got = frame(trees.gbt_forecast(spark.createDataFrame(pd.concat(parts), SCHEMA), NAMES, settings=QUICK), ["ticker", "fold", "date"])
    for pdf in parts:
        for fold in range(4):
            want, rounds = plain_boost(pdf, fold, QUICK)
            mine = got[(got.ticker == pdf["ticker"].iloc[0]) & (got.fold == fold)]
            same(mine["pred"], want, 1e-9)
            assert set(mine["rounds"]) == {rounds}
    assert np.corrcoef(got["pred"], got["actual"])[0, 1] > 0.7


@pytest.mark.parametrize("kept", [1, 8])
def test_long_groups_have_the_same_trees(spark, monkeypatch, kept):
    """Fitted over the cluster, by histograms of all groups per level."""
    pdf = pd.concat([steps(150, 3), steps(120, 4, "b"), steps(60, 5, "short")])
    df = spark.createDataFrame(pdf, SCHEMA)
    s = replace(QUICK, rounds=4, patience=2)
    want = frame(trees.gbt_forecast(df, NAMES, settings=s), ["ticker", "fold", "date"])
    monkeypatch.setattr(trees, "TASK_ROWS", 100)
    monkeypatch.setattr(trees, "TOGETHER", 4)
    monkeypatch.setattr(trees, "KEPT_ROUNDS", kept)
    got = frame(trees.gbt_forecast(df, NAMES, settings=s), ["ticker", "fold", "date"])
    pd.testing.assert_frame_equal(got, want)


def test_rounds_do_not_depend_on_the_units_of_the_target(spark):
    """Early stopping with patience: a chance rise of the held-out error does not end a fit."""
    s = Settings(leaves=8, rounds=120, patience=20, least=10)
    parts = [steps(400, 9, f"s{i}", scale) for i, scale in enumerate((1.0, 0.005, 1e-4))]
    got = trees.gbt_forecast(spark.createDataFrame(pd.concat(parts), SCHEMA), NAMES, settings=s).toPandas()
    rounds = got.groupby(["fold", "ticker"])["rounds"].first().unstack()
    assert (rounds.nunique(axis=1) == 1).all() and (rounds["s0"] > 20).all()


def test_trees_at_the_edges(spark):
    """Constant and missing columns, a constant target, too few rows: the mean of the training rows."""
    n = 40
    flat = pd.DataFrame({"ticker": "flat", "date": pd.date_range("2020-01-01", periods=n).date, "x": 1.0, "z": np.nan, "gap": 2.0, "target": 3.0})
    few = steps(9, 1, "few")
    got = trees.gbt_forecast(spark.createDataFrame(pd.concat([flat, few]), SCHEMA), NAMES, settings=QUICK).toPandas()
    assert set(got[got.ticker == "flat"]["pred"]) == {3.0} and set(got["rounds"]) == {0}
    y = few["target"].to_numpy()
    for r in got[got.ticker == "few"].itertuples():
        assert abs(r.pred - y[:9 - (4 - r.fold)].mean()) < 1e-4
    assert trees.gbt_forecast(spark.createDataFrame([], SCHEMA), NAMES, settings=QUICK).count() == 0


def test_many_tickers_in_one_plan(spark):
    one = steps(60, 6)
    pdf = pd.concat([one.assign(ticker=f"t{i}") for i in range(300)])
    got = trees.gbt_forecast(spark.createDataFrame(pdf, SCHEMA), NAMES, n_splits=1, settings=replace(QUICK, rounds=2)).toPandas()
    assert got["ticker"].nunique() == 300 and got.groupby("date")["pred"].nunique().max() == 1


def test_search_keeps_what_separate_fits_find(spark, monkeypatch):
    df = spark.createDataFrame(pd.concat([steps(200, 7), steps(160, 8, "b")]), SCHEMA)
    trials = [replace(t, rounds=40, least=5) for t in trees.space(5)]
    got = trees.gbt_search(df, NAMES, trials, first=4).toPandas()
    assert len(got) == 2 * 4 * 5 and got["stopped"].notna().any()
    for (ticker, fold), part in got.groupby(["ticker", "fold"]):
        assert part["stopped"].isna().any()
    # The last to stay: the rounds of the fit that it has alone.
    stayed = got[got["stopped"].isna()]
    for trial in sorted(set(stayed["trial"])):
        alone = trees.gbt_forecast(df, NAMES, settings=trials[trial]).toPandas().groupby(["ticker", "fold"])["rounds"].first()
        for r in stayed[stayed.trial == trial].itertuples():
            assert alone[(r.ticker, r.fold)] == r.rounds
    # Long groups search every trial to its end.
    monkeypatch.setattr(trees, "TASK_ROWS", 50)
    two = [replace(t, rounds=3, patience=3) for t in trials[:2]]
    long = trees.gbt_search(df, NAMES, two).toPandas().sort_values(["ticker", "fold", "trial"])
    monkeypatch.setattr(trees, "TASK_ROWS", 10_000)
    short = trees.gbt_search(df, NAMES, two, first=100).toPandas().sort_values(["ticker", "fold", "trial"])
    assert long["rounds"].tolist() == short["rounds"].tolist()
    same(long["loss"], short["loss"], 1e-6)


# --- refits and windows ------------------------------------------------------------------------

def ridge(x, y, strength):
    m, s = x.mean(0), x.std(0)
    s[s == 0] = 1.0
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + strength * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda t: (t - m) / s @ w + y.mean()


@pytest.mark.parametrize("block", [256, 3])
def test_refits_before_every_step(spark, small_blocks, monkeypatch, walk_df, block):
    """18 technical columns, against a direct fit of every step."""
    monkeypatch.setattr(refits, "STEPS", block)
    table = features.technical_frame(walk_df).cache()
    names = list(S.TECHNICAL_FEATURES)
    got = frame(refits.walk_forward_ridge(table, names, strength=2.0), ["ticker", "fold", "date"])
    pdf = table.toPandas()
    for ticker in ("HOT", "B"):
        g = pdf[pdf.ticker == ticker].sort_values("date")
        x, y = g[names].to_numpy(), g["target"].to_numpy()
        mine = got[got.ticker == ticker]
        folds = (len(g) - 200) // 25
        assert sorted(mine["fold"].unique()) == list(range(folds))
        for fold in range(folds):
            start = 200 + 25 * fold
            part = mine[mine.fold == fold]
            same(part["pred"], ridge(x[:start], y[:start], 2.0)(x[start:start + 25]), 1e-6)
            same(part["actual"], y[start:start + 25])
    assert "TINY" not in set(got.ticker)


@pytest.mark.parametrize("block_rows", [None, 40])
def test_window_models(spark, walk_df, block_rows):
    """Windows of five rows of two columns, against windows that are written out."""
    names = ["close", "open"]
    got = frame(refits.sequence_ridge(walk_df, names, "close", window=5, strength=0.5, block_rows=block_rows), ["ticker", "fold", "date"])
    pdf = walk_df.toPandas()
    for ticker in ("HOT", "C"):
        g = pdf[pdf.ticker == ticker].sort_values("date")
        v, y = g[names].to_numpy(), g["close"].to_numpy()
        x = np.array([v[k:k + 5].ravel() for k in range(len(v) - 5)])
        t = y[5:]
        size = len(x) // 5
        for fold in range(4):
            start = len(x) - (4 - fold) * size
            mine = got[(got.ticker == ticker) & (got.fold == fold)]
            same(mine["pred"], ridge(x[:start], t[:start], 0.5)(x[start:start + size]), 1e-6)
            same(mine["actual"], t[start:start + size])
            assert mine["date"].tolist() == g["date"].tolist()[4 + start:4 + start + size]
    assert refits.sequence_ridge(walk_df.limit(0), names, "close", window=5).count() == 0
