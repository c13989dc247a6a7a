"""Feature rows per message, from state that does not grow.

The batch form reads a ticker's last 450 messages again for every row. Here a ticker's state is a ring of
its last returns, its last known prices and logarithms and its last time, so a message costs its own
row. A row equals what the batch form gives on the messages up to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapework import schemas as S
from tapework.operators import columns

#: Returns that the longest lag looks back over.
RING = max(S.LAGS)
#: Rows of a ticker that are made at once.
SLICE = 1 << 14

ARRAYS = ("ring", "logs", "prices", "before")
STATE = T.StructType([T.StructField("last", T.LongType())] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ARRAYS])


@dataclass
class History:
    """What a ticker's next row needs of the earlier ones."""
    last: int = -(2 ** 62)
    #: The last returns of the close, oldest first.
    ring: np.ndarray = field(default_factory=lambda: np.empty(0))
    #: The latest known logarithm and price of each column; NaN where there is none.
    logs: np.ndarray = field(default_factory=lambda: np.full(len(S.PRICES), np.nan))
    prices: np.ndarray = field(default_factory=lambda: np.full(len(S.PRICES), np.nan))
    #: Logarithms of the row before, whether known or not: returns are between neighbouring rows.
    before: np.ndarray = field(default_factory=lambda: np.full(len(S.PRICES), np.nan))


def lags_and_moments(returns: np.ndarray, known: int) -> dict[str, np.ndarray]:
    """Lags, means and sample deviations before each of the last ``len(returns) - known`` returns; NaN
    where there are too few. Windows are sums of differences from a shared middle, so digits stay."""
    n = len(returns) - known
    at = known + np.arange(n)
    out = {}
    for k in S.LAGS:
        out[f"close_log_return_lag_{k}"] = np.where(at >= k, returns[np.maximum(at - k, 0)], np.nan)
    middle = returns.mean() if len(returns) else 0.0
    centred = returns - middle
    one, two = (np.concatenate([[0.0], np.cumsum(x)]) for x in (centred, centred * centred))
    for k in S.SHIFTED_WINDOWS:
        full, start = at >= k, np.maximum(at - k, 0)
        total, squares = one[at] - one[start], two[at] - two[start]
        out[f"close_log_return_mean_{k}"] = np.where(full, middle + total / k, np.nan)
        out[f"close_log_return_std_{k}"] = np.where(full, np.sqrt(np.maximum(squares - total * total / k, 0) / (k - 1)), np.nan)
    return out


def advance(history: History, time: np.ndarray, prices: np.ndarray) -> dict[str, np.ndarray]:
    """Features of rows later than the history, in order; the history then ends with the last of them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where(prices > 0, np.log(prices), np.nan)
    old = np.vstack([history.before, logs[:-1]])
    returns = logs - old
    returns[np.isnan(returns)] = 0.0  # the first row, and rows beside one without a logarithm
    close = S.PRICES.index("close")
    line = np.concatenate([history.ring, returns[:, close]])
    out = lags_and_moments(line, len(history.ring))
    for j, name in enumerate(S.PRICES):
        out[name], out[f"{name}_log"], out[f"{name}_log_return"] = (
            _filled(prices[:, j], history.prices[j]), _filled(logs[:, j], history.logs[j]), returns[:, j])
    history.ring, history.before = line[-RING:], logs[-1]
    history.prices = np.array([out[name][-1] for name in S.PRICES])
    history.logs = np.array([out[f"{name}_log"][-1] for name in S.PRICES])
    history.last = int(time[-1])
    return {name: np.where(np.isfinite(v), v, 0.0) for name, v in out.items()}


def _filled(values: np.ndarray, before: float) -> np.ndarray:
    """Missing values take the latest known one."""
    line = np.concatenate([[before], values])
    at = np.maximum.accumulate(np.where(np.isnan(line), 0, np.arange(len(line))))
    return line[at][1:]


def feature_names(lookback: int = S.LOOKBACK) -> list[str]:
    """What a row has: the training features and the return of the close."""
    return [*S.training_features(lookback), "close_log_return"]


def _follow(names: Sequence[str]):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history = History()
        if state.exists:
            last, *arrays = state.get
            history = History(last, *(np.array(x, float) for x in arrays))
        # Numbers only: a message is 48 bytes until its own row is made.
        held = [(p["ts"].to_numpy("datetime64[us]").astype(np.int64), p["offset"].to_numpy(), p[list(S.PRICES)].to_numpy(float)) for p in parts]
        time, offset, prices = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((offset, time))
        # Of a time the last arrival counts; what is not later than the history came too late.
        order = order[np.r_[time[order][1:] != time[order][:-1], True] & (time[order] > history.last)]
        for first in range(0, len(order), SLICE):
            some = order[first:first + SLICE]
            made = advance(history, time[some], prices[some])
            state.update((history.last, *(getattr(history, n).tolist() for n in ARRAYS)))
            yield pd.DataFrame({"ticker": key[0], "ts": time[some].astype("datetime64[us]"), "offset": offset[some], **{n: made[n] for n in names}})
    return run


def message_features(timed: DataFrame, names: Sequence[str], lookback: int = S.LOOKBACK) -> DataFrame:
    """``(ticker, ts, offset, names...)``: the feature row of every candle message, on a stream.

    ``timed`` has ``ts`` and the prices; ticks are left out. A ticker's messages are taken in the order of
    time inside a micro-batch; one that is not later than what has been seen adds no row. Unknown names
    are 0.
    """
    known = feature_names(lookback)
    rows = timed.where("interval <> 'tick'").select("ticker", "ts", "offset", *S.PRICES)
    schema = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("offset", T.LongType())]
                          + [T.StructField(n, T.DoubleType()) for n in known])
    made = rows.groupBy("ticker").applyInPandasWithState(_follow(known), schema, STATE, "append", GroupStateTimeout.NoTimeout)
    return columns.project_features(made, list(names), keep=("ticker", "ts", "offset"))
