"""Latency percentiles from mergeable histograms kept in a query's state.

A delay goes to a bucket of its leading eight bits: delays under 256 ms are exact, longer ones are off by
under one part in 128. Buckets are whole numbers and their counts add up, over batches, tickers and
tables alike, so nothing is read again and no list of delays is held.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapework.streaming import candles

#: Leading bits that a bucket keeps, and the largest relative error that follows.
BITS = 8
ERROR = 2 / (1 << BITS)


def bucket(delay: Column) -> Column:
    """Smallest delay of the bucket; negative delays (clocks that differ) count as 0."""
    whole = F.greatest(delay.cast("bigint"), F.lit(0).cast("bigint"))
    drop = F.greatest(F.length(F.bin(whole)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", whole, drop), drop)


def counts(timed: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """``(keys, bucket, messages)`` of messages stamped with ``consumed_at``, on a stream or a table."""
    delay = F.unix_millis("consumed_at") - F.unix_millis("ts")
    return timed.select(*keys, bucket(delay).alias("bucket")).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("messages"))


def keep_counts(timed: DataFrame, path: str, checkpoint: str, mode: str | None = None) -> StreamingQuery:
    """The histogram of all messages so far, written whole after every micro-batch: some hundred rows a key."""
    spark = timed.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        candles._replace_batch(batch, path, number)
        candles._drop_batches_before(spark, path, number - 1)

    writer = counts(timed).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return candles.cadence(writer, mode).start()


def read_counts(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def percentiles(histogram: DataFrame, keys: Sequence[str] = ("ticker",), at: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``(keys, messages, p50_ms, ...)`` by nearest rank: the bucket of the smallest delay that so many are not
    above. Counts of equal buckets of several tables or of fewer keys are added first."""
    merged = histogram.groupBy(*keys, "bucket").agg(F.sum("messages").alias("messages"))
    whole = Window.partitionBy(*keys)
    placed = merged.withColumn("_upto", F.sum("messages").over(whole.orderBy("bucket"))).withColumn("_all", F.sum("messages").over(whole))
    return placed.groupBy(*keys).agg(F.max("_all").alias("messages"), *[
        F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(p)), F.col("bucket"))).alias(f"p{round(p * 100)}_ms") for p in at])
