"""Ingest job: raw files -> canonical bars -> upsert -> validation, as one Spark application.

``python -m tapework.plans.ingest --input RAW --output BARS [--ticker DEFAULT]`` under spark-submit.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapework.operators import clean, quality
from tapework.session import configure, materialize
from tapework.sources import files, tables


def ingest(spark: SparkSession, raw: str, output: str, default_ticker: str | None = None,
           min_rows: int = 1, business_days: bool = True) -> DataFrame:
    """Load a raw tree into the bar table and return the validation rows.

    A row read again replaces its earlier version, so the job can be repeated. Validation looks
    at what was read, what was loaded and what the table now holds for it.
    """
    read = files.read_raw(spark, raw, default_ticker, with_source=True)
    usable = read.where("ticker is not null and date is not null")
    # Folders carry the ingest date, so the greatest path is the latest delivery of a bar.
    rest = [c for c in usable.columns if c not in tables.KEYS]
    arrived = usable.withColumn("arrival", F.struct("source_file", *rest)).drop("source_file")
    loaded = materialize(clean.keep_last(arrived, tables.KEYS, "arrival").drop("arrival"), "bars")
    tables.upsert_bars(loaded, output)
    stored = files.read_bars(spark, output)
    return quality.validate(read, loaded, stored, min_rows, business_days=business_days)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--ticker", default=None)
    args = parser.parse_args()
    spark = configure(SparkSession.builder.appName("tapework-ingest").getOrCreate())
    quality.enforce(ingest(spark, args.input, args.output, args.ticker))
    spark.stop()


if __name__ == "__main__":
    main()
