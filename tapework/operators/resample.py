"""Candles from trades and coarser candles from finer ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ohlc(trades: DataFrame, keys: Sequence[str], price: str, sequence: str) -> DataFrame:
    """Candles from single trades; ``sequence`` is the unique arrival order."""
    return trades.groupBy(*keys).agg(
        F.min_by(price, sequence).alias("open"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, sequence).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def time_bucket(ts: Column, interval: str) -> Column:
    """Start of the candle a UTC time falls in: ``k``m, ``k``h, 1d, 1wk, 1mo.

    Minute steps restart every hour, and an hour candle always starts on the full hour.
    """
    if interval == "1d":
        return F.date_trunc("day", ts)
    if interval == "1wk":
        return F.date_trunc("week", ts)
    if interval == "1mo":
        return F.date_trunc("month", ts)
    if interval.endswith("h"):
        return F.date_trunc("hour", ts)
    if interval.endswith("m"):
        step = int(interval[:-1])
        hour = F.date_trunc("hour", ts)
        minute = F.floor(F.minute(ts) / step) * step
        return F.timestamp_seconds(F.unix_seconds(hour) + minute * 60)
    return ts


def resample(ticks: DataFrame, interval: str, price: str = "price", order: Sequence[str] = ("ts", "seq"),
             keys: Sequence[str] = ("ticker",), volume: Column | None = None) -> DataFrame:
    """Candles of one interval from ticks or finer candles' closes."""
    order_by = F.struct(*order)
    return ticks.groupBy(*keys, time_bucket(F.col(order[0]), interval).alias("bucket")).agg(
        F.min_by(price, order_by).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order_by).alias("close"),
        (F.count(F.lit(1)) if volume is None else F.sum(volume)).alias("volume"),
    )


def coarsen(bars: DataFrame, interval: str, keys: Sequence[str] = ("ticker",), order: str = "date") -> DataFrame:
    """Coarser candles from finer ones."""
    return bars.groupBy(*keys, time_bucket(F.col(order).cast("timestamp"), interval).alias("bucket")).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"),
    )


def bucket_last(ticks: DataFrame, interval: str, price: str = "price", sequence: str = "seq",
                keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """One price per bucket: the last arrival replaces earlier ones, late points fall in place."""
    return ticks.groupBy(*keys, time_bucket(F.col("ts"), interval).alias("bucket")).agg(
        F.max_by(price, sequence).alias("price"))
