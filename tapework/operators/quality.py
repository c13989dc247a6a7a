"""Profiles and validation rules. Each profile is one aggregate over all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapework.operators import clean


def _unpivoted(df: DataFrame, per_column: dict[str, Column], value: str) -> DataFrame:
    row = df.agg(*[c.alias(n) for n, c in per_column.items()])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").alias(value)) for n in per_column])))


def null_profile(df: DataFrame) -> DataFrame:
    return _unpivoted(df, {c: F.count_if(F.col(c).isNull()) for c in df.columns}, "nulls")


def inf_null_audit(df: DataFrame) -> DataFrame:
    """Infinite and missing values per numeric column."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return _unpivoted(df, {c: F.struct(
        F.count_if(F.abs(c) == float("inf")).alias("inf"),
        F.count_if(F.col(c).isNull() | F.isnan(c)).alias("missing")) for c in cols}, "v").select("field", "v.*")


def missing_map(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (panel.select("ticker", "date", *[F.col(c).isNull().alias(c) for c in columns])
            .unpivot(["ticker", "date"], list(columns), "field", "is_null"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("source"), "rows")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_check(df: DataFrame, columns: Sequence[str] = ("ticker", "date", "close")) -> DataFrame:
    """One row per required column: NULL count and whether it passes."""
    return _unpivoted(df.select(*columns), {c: F.count_if(F.col(c).isNull()) for c in columns}, "nulls").withColumn(
        "passed", F.col("nulls") == 0)


def validate(raw: DataFrame, processed: DataFrame, stored: DataFrame, min_rows: int = 1,
             max_gap_days: int = 2, business_days: bool = False) -> DataFrame:
    """One row per rule: ``rule, observed, bound, passed``."""
    counts = row_counts({"raw": raw, "processed": processed, "stored": stored})
    wide = counts.agg(*[F.max(F.when(F.col("source") == s, F.col("rows"))).alias(s)
                        for s in ("raw", "processed", "stored")])
    volume = wide.select(F.inline(F.array(
        F.struct(F.lit("min_rows").alias("rule"), F.col("processed").alias("observed"),
                 F.lit(min_rows).cast("bigint").alias("bound"), (F.col("processed") >= min_rows).alias("passed")),
        F.struct(F.lit("processed_within_raw").alias("rule"), F.col("processed").alias("observed"),
                 F.col("raw").alias("bound"), (F.col("processed") <= F.col("raw")).alias("passed")),
        F.struct(F.lit("stored_covers_processed").alias("rule"), F.col("stored").alias("observed"),
                 F.col("processed").alias("bound"), (F.col("stored") >= F.col("processed")).alias("passed")))))
    zero = F.lit(0).cast("bigint")
    nulls = null_check(stored).select(F.concat(F.lit("not_null_"), "field").alias("rule"),
                                      F.col("nulls").alias("observed"), zero.alias("bound"), "passed")
    long_gaps = clean.gaps(stored, max_gap_days, business_days).agg(F.count(F.lit(1)).alias("observed")).select(
        F.lit("continuity").alias("rule"), "observed", zero.alias("bound"), (F.col("observed") == 0).alias("passed"))
    return volume.unionByName(nulls).unionByName(long_gaps)


def enforce(rules: DataFrame) -> None:
    """Raise when a rule fails; the table has one row per rule."""
    failed = rules.where(~F.col("passed")).collect()
    if failed:
        raise AssertionError("; ".join(f"{r.rule}: observed {r.observed}, limit {r.bound}" for r in failed))
