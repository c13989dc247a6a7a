"""Calendar alignment, fills, duplicates, gaps and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.operators import series as R


def calendar(bars: DataFrame) -> DataFrame:
    """Distinct dates of all tickers, numbered: ``date, _pos, _rows``."""
    return R.with_position(bars.select("date").distinct(), [], ["date"])


def align(bars: DataFrame, chunk: int = 65536) -> DataFrame:
    """Every ticker on every date that occurs anywhere; prices are NULL where it did not trade.

    Each ticker unfolds the calendar's index range (in chunks, so no array grows with the
    calendar), then dates and bars are attached by equi-joins. The position on the calendar is
    kept, because the grid is complete: later ordered operators need no renumbering.
    """
    index = calendar(bars)
    size = index.select(F.max(R.ROWS)).scalar()
    grid = (
        bars.select("ticker").distinct()
        .select("ticker", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / chunk))).alias("_k"))
        .select("ticker", F.explode(F.sequence(F.col("_k") * chunk,
                                               F.least((F.col("_k") + 1) * chunk, size) - 1)).alias(R.POS))
    )
    return grid.join(index, R.POS).join(bars, ["ticker", "date"], "left")


def ffill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Carry the last known value forward. Rows must carry positions."""
    return R.running(df, keys, {c: ("last", f"`{c}`") for c in columns})


def bfill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Carry the next known value backward; this leaks later values into earlier rows."""
    return R.running(df, keys, {c: ("next", f"`{c}`") for c in columns})


def fill_chain(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("ticker",),
               default: float | None = 0.0) -> DataFrame:
    """Forward fill, then backward fill, then ``default``.

    After the forward fill only leading rows can be empty, so the backward fill is the first known
    value of the series and needs no second ordering.
    """
    spec = {}
    for c in columns:
        spec[f"_f_{c}"] = ("last", f"`{c}`")
        spec[f"_b_{c}"] = ("first", f"`{c}`")
    filled = R.running(df, keys, spec)
    kept = [c for c in df.columns if c not in columns]
    rest = "" if default is None else f", double({default})"
    return filled.select(*kept, *[F.expr(f"coalesce(`_f_{c}`, `_b_{c}`{rest}) as `{c}`") for c in columns])


def keep_last(df: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Latest arrival per key, by aggregation (merged before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), arrival).alias("_r"))
            .select(*keys, "_r.*").select(*df.columns))


def suppress_unchanged(df: DataFrame, keys: Sequence[str] = ("ticker",), arrival: str = "offset",
                       time: str = "timestamp", value: str = "close", tolerance: float = 1e-12) -> DataFrame:
    """Drop a candle whose time and close equal those of the one before it in arrival order."""
    def changed(rows, w):
        same = (F.lag(time).over(w) == F.col(time)) & (F.abs(F.lag(value).over(w) - F.col(value)) < tolerance)
        return rows.withColumn("_same", F.coalesce(same, F.lit(False)))
    numbered = R.with_position(df, keys, [arrival])
    return R.tiled(numbered, keys, changed, lookback=1).where(~F.col("_same")).drop("_same", R.POS, R.ROWS)


def index_gaps(bars: DataFrame) -> DataFrame:
    """Steps of more than one day in the shared date index."""
    def step(rows, w):
        return rows.withColumn("days", F.date_diff("date", F.lag("date").over(w)))
    return R.tiled(calendar(bars), [], step, lookback=1).where("days > 1").select("date", "days")


def gaps(bars: DataFrame, max_gap_days: int = 2, business_days: bool = False,
         ticker: str = "ticker", date: str = "date") -> DataFrame:
    """Steps longer than ``max_gap_days`` within a ticker; optionally not counting weekends."""
    def step(rows, w):
        return rows.withColumn("previous", F.lag(date).over(w))
    seen = bars.select(ticker, F.col(date).cast("date").alias(date)).distinct()
    stepped = R.tiled(R.with_position(seen, [ticker], [date]), [ticker], step, lookback=1)
    days = F.date_diff(date, "previous")
    if business_days:
        # Weekend days up to a date, counted from Monday 1969-12-29.
        weekend = lambda d: (F.floor((F.unix_date(d) + 3) / 7) * 2
                             + F.greatest(F.pmod(F.unix_date(d) + 3, F.lit(7)) - 4, F.lit(0)))
        days = days - (weekend(date) - weekend("previous"))
    return stepped.select(ticker, "previous", date, days.alias("days")).where(F.col("days") > max_gap_days)


def column_stats(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("ticker",)) -> DataFrame:
    return df.groupBy(*keys).agg(*chain_stats(columns))


def chain_stats(columns: Sequence[str]):
    for c in columns:
        yield F.avg(c).alias(f"_mean_{c}")
        yield F.stddev_pop(c).alias(f"_std_{c}")


def zscore(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("ticker",), suffix: str = "_z") -> DataFrame:
    """Population z-scores against the whole sample: one aggregate, joined back by key."""
    scored = df.join(column_stats(df, columns, keys), list(keys))
    return scored.select(*df.columns, *[
        ((F.col(c) - F.col(f"_mean_{c}")) / F.nullif(F.col(f"_std_{c}"), F.lit(0.0))).alias(f"{c}{suffix}")
        for c in columns])


def outlier_flags(df: DataFrame, columns: Sequence[str] = S.PRICES, limit: float = 3.0) -> DataFrame:
    scored = zscore(df, columns)
    return scored.select(*df.columns, *[
        F.coalesce(F.abs(f"{c}_z") > limit, F.lit(False)).cast("int").alias(f"{c}_is_outlier") for c in columns])


def outlier_counts(df: DataFrame, columns: Sequence[str] = S.PRICES, limit: float = 3.0) -> DataFrame:
    flags = outlier_flags(df, columns, limit)
    sums = flags.groupBy("ticker").agg(*[F.sum(f"{c}_is_outlier").alias(c) for c in columns])
    return sums.unpivot("ticker", list(columns), "price_type", "outliers")


def outlier_rows(df: DataFrame, columns: Sequence[str] = S.PRICES, limit: float = 3.0) -> DataFrame:
    any_flag = reduce(lambda a, b: a | b, [F.col(f"{c}_is_outlier") == 1 for c in columns])
    return outlier_flags(df, columns, limit).where(any_flag).select(*df.columns)


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row per key by aggregation; nothing is sorted."""
    return keep_last(df, keys, order)
