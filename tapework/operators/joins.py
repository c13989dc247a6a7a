"""Joins of features, models, live values and stored results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapework.functions import scalar as X


def live_override(history: DataFrame, live: DataFrame, period: str, interval: str) -> DataFrame:
    """Latest price per ticker: the exact (period, interval) slot, else any slot, else the last close.

    ``history`` has ``ticker, date, close``; ``live`` has ``ticker, period, interval, close, received``.
    The first slot that was ever filled stands in when the exact one is missing.
    """
    last = history.groupBy("ticker").agg(F.max_by("close", "date").alias("last_close"))
    exact = (F.col("period") == period) & (F.col("interval") == interval)
    slots = live.groupBy("ticker").agg(
        F.min_by("close", F.struct(F.when(exact, 0).otherwise(1).alias("p"), "received")).alias("live_close"))
    return last.join(slots, "ticker", "left").select(
        "ticker", "last_close", "live_close", F.coalesce("live_close", "last_close").alias("latest_price"))


def folded(models: DataFrame) -> DataFrame:
    """Model rows with the scaling folded into one array: ``_w`` and ``_b``, keys unchanged."""
    used = ("mean", "scale", "weights", "intercept")
    kept = [c for c in models.columns if c not in used]
    w = F.zip_with("weights", "scale", lambda w, s: w / s)
    shift = F.aggregate(F.zip_with("mean", "_w", lambda m, w: m * w), F.lit(0.0), lambda acc, t: acc + t)
    return models.withColumn("_w", w).select(*kept, "_w", (F.col("intercept") - shift).alias("_b"))


def linear_score(features: Sequence[str]) -> Column:
    """Dot product of a row with its folded model, written out term by term so that it compiles."""
    return F.expr(" + ".join(["`_b`", *[f"double(`{f}`) * `_w`[{i}]" for i, f in enumerate(features)]]))


def score_join(rows: DataFrame, models: DataFrame, features: Sequence[str], keys: Sequence[str] = ("ticker",),
               output: str = "pred", extra: Sequence[str] = ()) -> DataFrame:
    """Rows scored by the model (or models) of their key; ``extra`` keeps columns of the model side.

    The model side is one row per key and trial; whether it is broadcast is decided from its
    measured size, and skewed keys are split otherwise.
    """
    kept = rows.columns
    return rows.join(folded(models), list(keys)).select(*kept, *extra, linear_score(features).alias(output))


def batch_outcomes(requests: DataFrame, supported: DataFrame, scores: DataFrame) -> DataFrame:
    """A result or an error for every requested ticker."""
    known = supported.select("ticker").distinct().withColumn("_known", F.lit(True))
    joined = requests.join(known, "ticker", "left").join(scores, "ticker", "left")
    error = (F.when(F.col("_known").isNull(), "Unsupported ticker")
             .when(F.col("pred").isNull(), "Features not available"))
    return joined.select(
        "ticker", F.when(error.isNull(), F.round("pred", 6)).alias("predicted_log_return"),
        F.when(error.isNull(), X.direction_label(F.col("pred"))).alias("direction"), error.alias("error"))


def not_yet_scored(requests: DataFrame, stored: DataFrame, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Requests without a stored result of the same day."""
    return requests.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def fresh(rows: DataFrame, now: Column, seconds: int, stamp: str = "fetched_at") -> DataFrame:
    """Rows younger than ``seconds`` at ``now``."""
    return rows.where(F.unix_micros(now) - F.unix_micros(F.col(stamp).cast("timestamp")) < seconds * 1_000_000)


def forecast_point(points: DataFrame, predictions: DataFrame, time: str = "ts", price: str = "price") -> DataFrame:
    """Predicted price and its time: the last time plus the mean spacing (60 s if there is none)."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    last = points.groupBy("ticker").agg(
        F.max_by(price, time).alias("last_price"), F.max(micros).alias("_t"),
        ((F.max(micros) - F.min(micros)) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("_step"))
    step = F.coalesce(F.nullif(F.col("_step"), F.lit(0.0)), F.lit(60_000_000.0))
    return last.join(predictions, "ticker").select(
        "ticker", "last_price", (F.col("last_price") * F.exp("predicted_log_return")).alias("predicted_price"),
        F.floor((F.col("_t") + step) / 1000).cast("bigint").alias("forecast_ms"))
