"""Return, rolling, exponential and lag features.

Every feature looks back a known number of rows, so one ``tiled`` pass with one window ordering
computes a whole frame. A rolling value exists only when its window is full of values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapework import schemas as S
from tapework.operators import clean, columns
from tapework.operators import series as R
from tapework.session import materialize


def log_price(price: str) -> Column:
    return F.ln(F.col(price))


def log_return(price: str, w: WindowSpec) -> Column:
    return log_price(price) - F.lag(log_price(price)).over(w)


def _full(value: str, w: WindowSpec, first: int, last: int, agg) -> Column:
    frame = w.rowsBetween(first, last)
    return F.when(F.count(value).over(frame) == last - first + 1, agg(value).over(frame))


def rolling_mean(value: str, k: int, w: WindowSpec, shift: int = 0) -> Column:
    return _full(value, w, -(k - 1) - shift, -shift, F.avg)


def rolling_std(value: str, k: int, w: WindowSpec, shift: int = 0) -> Column:
    return _full(value, w, -(k - 1) - shift, -shift, F.stddev_samp)


def with_log_prices(df: DataFrame, prices: Sequence[str] = S.PRICES) -> DataFrame:
    return df.withColumns({f"{p}_log": log_price(p) for p in prices})


def with_diffs(rows: DataFrame, w: WindowSpec, prices: Sequence[str] = S.PRICES) -> DataFrame:
    return rows.withColumns({f"{p}_diff": F.col(p) - F.lag(p).over(w) for p in prices})


def with_log_returns(rows: DataFrame, w: WindowSpec, prices: Sequence[str] = S.PRICES) -> DataFrame:
    logs = with_log_prices(rows, prices)
    return logs.withColumns({f"{p}_log_return": F.col(f"{p}_log") - F.lag(f"{p}_log").over(w) for p in prices})


def with_lags(rows: DataFrame, w: WindowSpec, value: str = "close_log_return",
              lookback: int = S.LOOKBACK) -> DataFrame:
    return rows.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(w) for k in S.LAGS if k <= lookback})


def with_shifted_stats(rows: DataFrame, w: WindowSpec, value: str = "close_log_return",
                       lookback: int = S.LOOKBACK) -> DataFrame:
    """Mean and sample deviation of the previous k values, excluding the current row."""
    out = {}
    for k in S.SHIFTED_WINDOWS:
        if k <= lookback:
            out[f"{value}_mean_{k}"] = rolling_mean(value, k, w, shift=1)
            out[f"{value}_std_{k}"] = rolling_std(value, k, w, shift=1)
    return rows.withColumns(out)


#: Rows per block of an exponential mean. A span of 2 decays by 1.1 e-folds a row, so the powers of
#: a block stay far inside the range of a double for every span.
EMA_BLOCK = 512


def with_emas(df: DataFrame, value: str = "close", spans: Sequence[int] = S.EMA_SPANS,
              keys: Sequence[str] = ("ticker",), block_rows: int = EMA_BLOCK) -> DataFrame:
    """Recursive exponential means for several spans; rows must carry positions.

    The first value enters whole. A NULL keeps the mean, and the gap counts: after d rows without a
    value the old mean has weight q^d against alpha, with q = 1 - alpha. Written as
    ``y = a y' + b x``, a block turns the mean before it into the mean after it by one multiplication
    and one addition. Blocks are reduced to that, the carries run along the block table of a series,
    and inside a block everything is running sums, so no value is cut off whatever the span.
    """
    keys = list(keys)
    weights = [(s, 2 / (s + 1), 1 - 2 / (s + 1)) for s in spans]
    blocked = df.withColumn(R.BLOCK, F.expr(f"{R.POS} div {block_rows}"))
    w = Window.partitionBy(*keys, R.BLOCK).orderBy(R.POS)
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col(value).isNotNull(), F.col(R.POS))
    rows = blocked.withColumns({"_at": own, "_last": F.last(own, ignorenulls=True).over(before),
                                "_first": F.min(own).over(so_far), "_x": F.first(value, ignorenulls=True).over(so_far)})
    # Later values of the block, relative to its first one: mean = keep * first mean + local.
    step = F.col("_at") - F.col("_last")
    falls, locals_ = {}, {}
    for s, alpha, q in weights:
        if s == 1:
            falls["_s_1"] = F.lit(0.0)
            continue
        falls[f"_s_{s}"] = F.coalesce(F.sum(F.when(step.isNotNull(), F.log1p(F.lit(alpha) * F.pow(F.lit(1 / q), step)))).over(so_far), F.lit(0.0))
    rows = rows.withColumns(falls)
    for s, alpha, q in weights:
        if s == 1:
            locals_["_l_1"] = F.last(value, ignorenulls=True).over(so_far)
            continue
        share = F.lit(alpha) / (F.pow(F.lit(q), step) + F.lit(alpha))
        grown = F.sum(F.when(step.isNotNull(), share * F.col(value) * F.exp(f"_s_{s}"))).over(so_far)
        locals_[f"_l_{s}"] = F.coalesce(grown, F.lit(0.0)) * F.exp(-F.col(f"_s_{s}"))
    rows = rows.withColumns(locals_)
    ends = rows.groupBy(*keys, R.BLOCK).agg(
        F.max("_at").alias("_last"), F.min("_at").alias("_first"), F.min_by("_x", F.when(F.col("_x").isNotNull(), F.col(R.POS))).alias("_x"),
        *[F.max_by(c, R.POS).alias(c) for s in spans for c in (f"_s_{s}", f"_l_{s}")])
    carries = ends.groupBy(*keys).applyInPandas(
        _ema_carries(weights), T.StructType([ends.schema[k] for k in (*keys, R.BLOCK)] + [
            T.StructField(n, T.DoubleType()) for s in spans for n in (f"_in_{s}", f"_f_{s}")]))
    out = {}
    for s, _, _ in weights:
        keep = F.lit(0.0) if s == 1 else F.exp(-F.col(f"_s_{s}"))
        inside = keep * F.col(f"_f_{s}") + F.col(f"_l_{s}")
        out[f"{value}_ema_{s}"] = F.when(F.col("_first").isNull(), F.col(f"_in_{s}")).otherwise(inside)
    kept = [c for c in df.columns]
    return rows.join(carries, [*keys, R.BLOCK]).select(*kept, *[c.alias(n) for n, c in out.items()])


def _ema_carries(weights: Sequence[tuple[int, float, float]]):
    """Per block of a series, in order: the mean before it and the mean at its first value."""
    alpha, q = np.array([w[1] for w in weights]), np.array([w[2] for w in weights])
    one = np.array([w[0] == 1 for w in weights])

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(R.BLOCK)
        falls = blocks[[f"_s_{w[0]}" for w in weights]].to_numpy(float)
        local = blocks[[f"_l_{w[0]}" for w in weights]].to_numpy(float)
        mean, last = np.full(len(weights), np.nan), None
        incoming, firsts = np.empty_like(falls), np.full_like(falls, np.nan)
        for k, (first, x, end) in enumerate(zip(blocks["_first"], blocks["_x"], blocks["_last"])):
            incoming[k] = mean
            if first == first and first is not None:
                old = 0.0 if last is None else q ** (first - last)
                firsts[k] = x if last is None else (old * mean + alpha * x) / (old + alpha)
                mean = np.where(one, 0.0, np.exp(-falls[k])) * firsts[k] + local[k]
                last = end
        out = blocks[[c for c in blocks.columns if not c.startswith(("_s_", "_l_")) and c not in ("_last", "_first", "_x")]].copy()
        for i, w in enumerate(weights):
            out[f"_in_{w[0]}"], out[f"_f_{w[0]}"] = incoming[:, i], firsts[:, i]
        return out.replace({np.nan: None}).astype({f"_{n}_{w[0]}": "float64" for w in weights for n in ("in", "f")})
    return run


def with_price_features(rows: DataFrame, w: WindowSpec) -> DataFrame:
    """Momentum, moving means, volatility, range and direction of the close."""
    rows = rows.withColumns({
        f"close_momentum_{S.MOMENTUM}": F.col("close") - F.lag("close", S.MOMENTUM).over(w),
        **{f"close_ma_{k}": rolling_mean("close", k, w) for k in S.MA_WINDOWS},
        **{f"close_log_return_vol_{k}": rolling_std("close_log_return", k, w) for k in S.VOL_WINDOWS},
    })
    return rows.withColumns(range_features()).withColumn("close_direction", direction_sign("close_log_return"))


def range_features() -> dict[str, Column]:
    spread = F.col("high") - F.col("low")
    return {"high_low_range": spread, "high_low_range_pct": spread / F.nullif(F.col("low"), F.lit(0.0))}


def direction_sign(log_return_column: str) -> Column:
    return F.signum(F.coalesce(F.col(log_return_column), F.lit(0.0)))


def positioned(bars: DataFrame) -> DataFrame:
    return R.with_position(bars, ["ticker"], ["date"])


def plain(df: DataFrame) -> DataFrame:
    return df.drop(R.POS, R.ROWS)


def training_frame(bars: DataFrame, lookback: int = S.LOOKBACK, horizon: int = S.HORIZON,
                   extra: Sequence[str] = ()) -> DataFrame:
    """Ordered features and the target, complete rows only; nothing looks ahead but the target."""
    names = S.training_features(lookback)

    def build(rows, w):
        rows = with_log_returns(rows, w)
        rows = with_shifted_stats(with_lags(rows, w, lookback=lookback), w, lookback=lookback)
        return rows.withColumn("target", F.lead("close_log_return", horizon).over(w))

    reach = max([k for k in S.LAGS if k <= lookback] + [k for k in S.SHIFTED_WINDOWS if k <= lookback]) + 1
    frame = R.tiled(positioned(bars.select("ticker", "date", *S.PRICES)), ["ticker"], build,
                    lookback=reach, lookahead=horizon)
    return columns.drop_incomplete(frame.select("ticker", "date", *names, *extra, "target"))


def inference_frame(bars: DataFrame, lookback: int = S.LOOKBACK, order: str = "date") -> DataFrame:
    """Serving features: the first return is 0 and gaps are filled instead of dropped."""
    def build(rows, w):
        rows = with_log_returns(rows, w)
        rows = rows.withColumns({f"{p}_log_return": F.coalesce(f"{p}_log_return", F.lit(0.0)) for p in S.PRICES})
        return with_shifted_stats(with_lags(rows, w, lookback=lookback), w, lookback=lookback)

    numbered = R.with_position(bars, ["ticker"], [order])
    frame = R.tiled(numbered, ["ticker"], build, lookback=max(S.LAGS) + 1)
    # The fill reads the frame twice (rows and block totals), so it is computed once and stored.
    frame = materialize(columns.infinities_to_null(frame), "serving")
    numbers = [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType) and f.name not in (R.POS, R.ROWS, order)]
    filled = plain(clean.fill_chain(frame, numbers))
    whole = {f.name: f.dataType for f in frame.schema if f.name in numbers and not isinstance(f.dataType, T.DoubleType)}
    return filled.withColumns({c: F.col(c).cast(kind) for c, kind in whole.items()})


def inference_frame_raw(bars: DataFrame, lookback: int = S.LOOKBACK) -> DataFrame:
    """Serving features without fills, in training order; incomplete rows keep NULLs."""
    def build(rows, w):
        rows = with_log_returns(rows, w)
        return with_shifted_stats(with_lags(rows, w, lookback=lookback), w, lookback=lookback)

    frame = R.tiled(positioned(bars.select("ticker", "date", *S.PRICES)), ["ticker"], build,
                    lookback=max(S.LAGS) + 1)
    return frame.select("ticker", "date", *S.training_features(lookback))


def technical_frame(bars: DataFrame, horizon: int = S.HORIZON) -> DataFrame:
    """The walk-forward model's columns and its target, complete rows only."""
    def build(rows, w):
        rows = with_price_features(with_log_returns(rows, w), w)
        return rows.withColumn("target", F.lead("close_log_return", horizon).over(w))

    base = with_emas(positioned(bars.select("ticker", "date", *S.PRICES)))
    frame = R.tiled(base, ["ticker"], build, lookback=max(S.MA_WINDOWS) + 1, lookahead=horizon)
    return columns.drop_incomplete(frame.select("ticker", "date", *S.TECHNICAL_FEATURES, "target"))


def sequences(df: DataFrame, features: Sequence[str], target: str, window: int = 30, horizon: int = 3,
              order: str = "date") -> DataFrame:
    """Sliding windows of feature rows and the targets that follow each of them."""
    def build(rows, w):
        rows = rows.withColumn("x", F.collect_list(F.array(*features)).over(w.rowsBetween(-(window - 1), 0)))
        return rows.withColumn("y", F.collect_list(target).over(w.rowsBetween(1, horizon)))

    rows = R.tiled(R.with_position(df, ["ticker"], [order]), ["ticker"], build,
                   lookback=window - 1, lookahead=horizon)
    return (rows.where((F.size("x") == window) & (F.size("y") == horizon))
            .select("ticker", order, "x", "y"))
