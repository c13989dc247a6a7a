import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tapework.operators import series as R  # noqa: E402
from tapework.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tapework-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks, slots and bins so small that every series crosses many of them."""
    monkeypatch.setattr(R, "BLOCK_ROWS", 16)
    monkeypatch.setattr(R, "EDGE_SHARE", 1)
    monkeypatch.setattr(R, "RUN_ROWS", 8)
    monkeypatch.setattr(R, "SLOT_DAYS", 5)
    monkeypatch.setattr(R, "SLOT_SECONDS", 50)
    monkeypatch.setattr(R, "SLOT_INTEGERS", 7)
    monkeypatch.setattr(R, "VALUE_BINS", 4)


@pytest.fixture(scope="session")
def walk():
    """Random-walk bars of four tickers with gaps; the first holds half of the rows."""
    rng = np.random.default_rng(3)
    parts = []
    for ticker, n in (("HOT", 700), ("B", 320), ("C", 260), ("TINY", 3)):
        days = np.sort(rng.choice(1500, n, replace=False))
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        spread = close * rng.uniform(0.001, 0.02, n)
        parts.append(pd.DataFrame({
            "ticker": ticker, "date": (pd.Timestamp("2019-01-01") + pd.to_timedelta(days, unit="D")).date,
            "open": np.roll(close, 1), "high": close + spread, "low": close - spread, "close": close,
            "volume": rng.integers(1, 1000, n)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="session")
def walk_df(spark, walk):
    return spark.createDataFrame(
        walk, "ticker string, date date, open double, high double, low double, close double, volume bigint").cache()


def frame(df, by=("ticker", "date")):
    """Result as pandas, sorted."""
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def same(left, right, tolerance=1e-9):
    left, right = np.asarray(left, dtype=float), np.asarray(right, dtype=float)
    np.testing.assert_allclose(left, right, rtol=tolerance, atol=tolerance, equal_nan=True)
