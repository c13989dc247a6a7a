"""Column names, subsets and row filters of incoming frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapework import schemas as S
from tapework.functions import scalar as X


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case names with underscores, renamed in one projection."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def with_date(df: DataFrame) -> DataFrame:
    """Find the date column (``date``, ``timestamp`` or ``datetime``) and cast it to a date."""
    found = next((c for c in ("date", "timestamp", "datetime") if c in df.columns), None)
    if found is None:
        raise ValueError(f"no date column among {df.columns}")
    value = F.col(found)
    if isinstance(df.schema[found].dataType, T.StringType):
        value = F.substring(F.trim(value), 1, 10).try_cast("date")
    out = df.withColumn("date", value.cast("date"))
    return out if found == "date" else out.drop(found)


def cast_to(value: Column, kind: T.DataType) -> Column:
    """``try_cast``; whole numbers may be written as decimals (``1000.0``) or in exponent form."""
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return F.coalesce(value.try_cast(kind), F.nanvl(value.try_cast("double"), F.lit(None).cast("double")).try_cast(kind))
    return value.try_cast(kind)


def canonical(df: DataFrame) -> DataFrame:
    """Canonical bar columns that are present, in order, with their declared types."""
    return df.select(*[cast_to(F.col(f.name), f.dataType).alias(f.name) for f in S.BAR if f.name in df.columns])


def conform(df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """All canonical columns, and those named in ``more``; missing ones are typed NULLs."""
    return df.select(*[(cast_to(F.col(f.name), f.dataType) if f.name in df.columns
                        else F.lit(None).cast(f.dataType)).alias(f.name) for f in S.BAR], *more)


def default_ticker(extracted: Column, default: str | None) -> Column:
    return F.coalesce(F.nullif(F.trim(extracted), F.lit("")), F.lit(default))


def drop_volume(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c == "volume" or c.endswith("_volume")])


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns is not None else None)


def infinities_to_null(df: DataFrame) -> DataFrame:
    """Infinite and not-a-number values of every floating column become NULL."""
    return df.select(*[F.expr(f"if(abs(`{f.name}`) < double('infinity'), `{f.name}`, null) as `{f.name}`")
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else f.name for f in df.schema])


def finite_rows(df: DataFrame, column: str = "close") -> DataFrame:
    return df.where(X.finite(F.col(column)))


def project_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """A model's features in its own order; absent ones are 0.0, bad values are 0.0."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*keep, *[
        (X.numeric_or_zero(F.col(have[f.lower()])) if f.lower() in have else F.lit(0.0)).alias(f)
        for f in features])


def selected_features(df: DataFrame, keep: Sequence[str] = ("ticker", "date")) -> DataFrame:
    return df.select(*keep, *[f"{p}{s}" for p in S.PRICES for s in ("", "_log", "_log_return")])


def valid_points(df: DataFrame) -> DataFrame:
    """Points with at least one price, as JSON that omits the missing fields."""
    fields = [c for c in (*S.PRICES, "volume") if c in df.columns]
    return (df.where(F.coalesce(*[F.col(p) for p in S.PRICES]).isNotNull())
            .select("ticker", "date", F.to_json(F.struct("date", *fields)).alias("point")))


def pivot_panel(df: DataFrame, tickers: Sequence[str], fields: Sequence[str] = S.PRICES) -> DataFrame:
    """Long to wide, for a declared list of tickers (their number bounds the columns)."""
    return df.groupBy("date").agg(*[
        F.max(F.when(F.col("ticker") == t, F.col(f))).alias(f"{t}_{f}") for t in tickers for f in fields])


def unpivot_panel(wide: DataFrame, tickers: Sequence[str], fields: Sequence[str] = S.PRICES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(t).alias("ticker"), *[F.col(f"`{t}_{f}`").alias(f) for f in fields])
                     for t in tickers])
    return wide.select("date", F.inline(rows)).where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())
