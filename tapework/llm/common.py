"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapework.session import configure, scratch

#: Rows handed to Python at once. Texts can be very long, so batches stay short.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators here: short Arrow batches, so that a worker's memory is
    bounded by a few long texts and not by ten thousand of them."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back: lineage is cut, lost
    executors re-read files, and Spark knows the true size when it chooses a join."""
    path = scratch(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Internal column names that clash with none of the given ones."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))
