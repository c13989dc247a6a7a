"""Views of the driver tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapework.operators.resample import ohlc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: order priority as ticker, order price as trade price."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("price"), "o_orderkey",
    )
    return ohlc(orders, ["ticker", "date"], price="price", sequence="o_orderkey")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), F.col("value").alias("price"), "user_id",
    )


def messages(spark: SparkSession, sf_dir: str, doubled: bool = False) -> DataFrame:
    """Topic records. ``doubled`` appends a second delivery of every record."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+00:00"), F.lit("")), (F.col("seq") % 3 + 1).cast("int"))
    rows = ticks(spark, sf_dir).select(
        F.concat(F.lit("instant_"), F.lower("ticker")).alias("topic"),
        F.pmod("user_id", F.lit(16)).cast("int").alias("partition"),
        F.col("seq").alias("offset"), "ticker", F.lit("1d").alias("period"),
        F.when(F.col("user_id") % 5 == 0, "tick").otherwise("1m").alias("interval"),
        F.concat(text, zone).alias("timestamp"),
        (F.col("price") * 1.25).alias("open"), (F.col("price") * 2).alias("high"), (F.col("price") / 2).alias("low"),
        F.col("price").alias("close"), (F.col("user_id") % 1000 + 1).cast("bigint").alias("volume"),
    )
    if doubled:
        rows = rows.unionByName(rows.withColumn("offset", F.col("offset") + F.lit(1_000_000_000)))
    return rows
