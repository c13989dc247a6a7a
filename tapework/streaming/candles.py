"""Continuous jobs over message topics.

Inputs are streaming frames with the record columns (key, value, topic, partition, offset), from
Kafka or from files. Row-order logic that Spark does not allow on streams (lags, fills) runs on the
landed table or, for duplicate suppression, in per-ticker state. Micro-batches are bounded by the
source's trigger limit, which also bounds what one key can bring into a task at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapework.functions import scalar as X
from tapework.operators import clean, columns, features, joins, ranking
from tapework.sources import tables, topics

# Run modes and how often each one fires.
CADENCE = {"instant": "1 second", "hourly": "1 hour", "daily": "24 hours"}

LATEST_TTL = 60
CACHE_TTL = 300


def subscribe(spark: SparkSession, servers: str, names: list[str], limit: int = 1_000_000) -> DataFrame:
    """Kafka topics as records; ``limit`` bounds the offsets taken per trigger."""
    return (spark.readStream.format("kafka").options(**topics.kafka_options(servers, names))
            .option("maxOffsetsPerTrigger", limit).load()
            .select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset"))


def from_files(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Records landed as Parquet files, taken a few files per trigger."""
    return (spark.readStream.schema(topics.RECORD).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def cadence(writer, mode: str | None):
    """Trigger of a run mode; without one, everything available is processed and the query stops."""
    return writer.trigger(processingTime=CADENCE[mode]) if mode else writer.trigger(availableNow=True)


def with_event_time(decoded: DataFrame) -> DataFrame:
    return topics.well_formed(decoded).withColumn("ts", X.parse_timestamp(F.col("timestamp"))).where("ts is not null")


def _replace_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write a micro-batch under its own folder, so a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def land(records: DataFrame, path: str, checkpoint: str, mode: str | None = None) -> StreamingQuery:
    """Decoded, well-formed messages appended to a table."""
    out = topics.well_formed(topics.decode(records)).drop("payload")
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return cadence(writer.outputMode("append"), mode).start()


def quarantine(records: DataFrame, good: str, bad: str, checkpoint: str, mode: str | None = None) -> StreamingQuery:
    """Good messages to one table; undecodable ones and ones with impossible numbers, with their
    payload, to another."""
    def split(batch: DataFrame, number: int) -> None:
        fine = topics.is_well_formed(batch)
        batch.persist()
        try:
            _replace_batch(batch.where(fine).drop("payload"), good, number)
            _replace_batch(batch.where(~fine).select("topic", "partition", "offset", "payload"), bad, number)
        finally:
            batch.unpersist()
    writer = topics.decode(records).writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return cadence(writer, mode).start()


def _unchanged(key, parts: Iterator[pd.DataFrame], state: GroupState, tolerance: float = 1e-12) -> Iterator[pd.DataFrame]:
    """Rows of one ticker that say something new; the state is its last candle's time and close."""
    last_time, last_close = state.get if state.exists else (None, float("nan"))
    rows = pd.concat(list(parts)).sort_values("offset")
    quote = (rows["interval"] == "tick").to_numpy()
    time, close = rows["timestamp"].to_numpy(dtype=object), rows["close"].to_numpy(dtype=float)
    # Index of the latest candle before each row; -1 stands for the candle in the state.
    seen = np.maximum.accumulate(np.where(quote, -1, np.arange(len(rows))))
    before = np.concatenate([[-1], seen[:-1]])
    old_time = np.where(before < 0, last_time, time[np.maximum(before, 0)])
    old_close = np.where(before < 0, last_close, close[np.maximum(before, 0)])
    repeated = (time == old_time) & (np.abs(close - old_close) < tolerance)
    same = np.where(quote, close == old_close, repeated)
    if seen[-1] >= 0:
        state.update((time[seen[-1]], float(close[seen[-1]])))
    yield rows[~same]


def suppressed(decoded: DataFrame) -> DataFrame:
    """Candles that differ from the ticker's previous candle in time or close, and tick quotes
    whose price differs from the latest candle's close."""
    rows = topics.well_formed(decoded).select("ticker", "timestamp", "interval", "close", "offset")
    return rows.groupBy("ticker").applyInPandasWithState(
        _unchanged, rows.schema, "timestamp string, close double", "append", GroupStateTimeout.NoTimeout)


def latest(decoded: DataFrame) -> DataFrame:
    """Newest message per (ticker, period, interval), by time, topic, partition and offset."""
    rows = with_event_time(decoded)
    keys = ["ticker", "period", "interval"]
    rest = [c for c in ("ts", "topic", "partition", "offset", "timestamp", "open", "high", "low", "close", "volume") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*topics.arrival(rows.columns))).alias("m")).select(*keys, "m.*")


def _drop_batches_before(spark: SparkSession, path: str, batch: int) -> None:
    """Delete the folders of earlier micro-batches."""
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = home.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in system.listStatus(home):
        name = entry.getPath().getName()
        if name.startswith("batch=") and int(name.removeprefix("batch=")) < batch:
            system.delete(entry.getPath(), True)


def keep_latest(decoded: DataFrame, path: str, checkpoint: str, mode: str | None = None) -> StreamingQuery:
    """The table of latest values, written whole after every micro-batch: it has one row per slot.
    The one before stays for readers that have begun, older ones are deleted."""
    spark = decoded.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        _replace_batch(batch, path, number)
        _drop_batches_before(spark, path, number - 1)

    writer = latest(decoded).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint)
    return cadence(writer, mode).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == newest).drop("batch", "ts")


def read_fresh(spark: SparkSession, path: str, now, seconds: int = LATEST_TTL) -> DataFrame:
    """Latest values that have not expired at ``now``."""
    return joins.fresh(read_latest(spark, path).withColumn("received_at", X.parse_timestamp(F.col("timestamp"))),
                       now, seconds, "received_at")


def fold_ticks(decoded: DataFrame, chart_interval: str = "1m") -> DataFrame:
    """Tick quotes become candles of the chart's interval: their price is open, high, low and close,
    and each counts one."""
    tick = F.col("interval") == "tick"
    return decoded.withColumns({
        **{c: F.when(tick, F.col("close")).otherwise(F.col(c)) for c in ("open", "high", "low") if c in decoded.columns},
        "volume": F.when(tick, F.lit(1).cast("bigint")).otherwise(F.col("volume")),
        "interval": F.when(tick, chart_interval).otherwise(F.col("interval"))})


def candles(timed: DataFrame, width: str, lateness: str = "1 hour", keys=("ticker",)) -> DataFrame:
    """Candles from messages with event time: the first message's open, the last one's close, and the
    sum of the volumes. Late messages within ``lateness`` are merged by time."""
    order = F.struct(*topics.arrival(timed.columns))
    return (timed.withWatermark("ts", lateness).groupBy(*keys, F.window("ts", width))
            .agg(F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"))
            .select(*keys, F.col("window.start").alias("bucket"), "open", "high", "low", "close", "volume"))


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str | None = None) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return cadence(writer.outputMode("append"), mode).start()


def envelope(decoded: DataFrame) -> DataFrame:
    """Update messages for subscribers."""
    fields = [c for c in topics.FIELDS if c in decoded.columns]
    return topics.well_formed(decoded).select(
        F.lit("price_update").alias("type"), "ticker", X.partition_key(F.col("period"), F.col("interval")).alias("partition"),
        F.to_json(F.struct(*fields)).alias("data"), "offset")


def publish(decoded: DataFrame, path: str, checkpoint: str, mode: str | None = None) -> StreamingQuery:
    """Every update to the updates sink, once per micro-batch even when a batch is repeated."""
    writer = (envelope(decoded).writeStream.foreachBatch(lambda b, n: _replace_batch(b, path, n))
              .option("checkpointLocation", checkpoint))
    return cadence(writer, mode).start()


def dual_sink(timed: DataFrame, table: str, updates: str, checkpoint: str, mode: str | None = "daily") -> StreamingQuery:
    """First message per (ticker, ts) into a table, every message on to a topic sink.

    The table is laid out by date and only the batch's range of dates is read back, so the check for
    existing keys does not grow with the table's history. Repeating a batch inserts nothing new.
    """
    spark = timed.sparkSession
    kept = timed.select("ticker", "ts", "open", "high", "low", "close", "volume", "offset", F.to_date("ts").alias("date"))
    schema = kept.drop("offset").schema
    spark.createDataFrame([], schema).write.mode("append").partitionBy("date").parquet(table)

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            rows = batch.select(*kept.columns)
            days = rows.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
            stored = spark.read.schema(schema).parquet(table).where(F.col("date").between(days["first"], days["last"]))
            fresh = tables.insert_ignore(stored, rows, ["ticker", "ts"], arrival="offset")
            fresh.select(*schema.names).write.mode("append").partitionBy("date").parquet(table)
            _replace_batch(topics.encode(batch.withColumn(
                "topic", X.topic_name(F.lit("daily"), F.col("ticker")))), updates, number)
        finally:
            batch.unpersist()

    source = timed.withColumn("date", F.to_date("ts"))
    return cadence(source.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint), mode).start()


def status(query: StreamingQuery, spark: SparkSession, mode: str, tickers: DataFrame, cached: DataFrame, received: DataFrame) -> DataFrame:
    """State of a query with the rows received so far, the number of tickers and of those that have
    values. Rows are counted in the landed table; a query's own progress keeps its last batches only."""
    running = query.isActive
    head = spark.createDataFrame([(("streaming" if running else "stopped"), mode if running else None)], "status string, mode string")
    return head.select("*", received.agg(F.count(F.lit(1))).scalar().alias("input_rows"),
                       tickers.agg(F.count_distinct("ticker")).scalar().alias("tickers"),
                       cached.agg(F.count_distinct("ticker")).scalar().alias("cached_tickers"))


def consumed(timed: DataFrame, at: Column | None = None) -> DataFrame:
    """Stamp messages with the time they were consumed (the micro-batch's, unless given)."""
    return timed.withColumn("consumed_at", F.current_timestamp() if at is None else at)


def latency_rows(landed: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Produce-to-consume latency percentiles over all stamped messages of a landed table."""
    delay = F.unix_millis("consumed_at") - F.unix_millis("ts")
    p = lambda q: F.percentile(delay, q).cast("bigint")
    return landed.groupBy(*keys).agg(F.count(F.lit(1)).alias("messages"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), p(0.99).alias("p99_ms"))


# Kinds of topics, the preferred one first.
TOPIC_ORDER = ("instant", "hourly", "daily")


def preferred_topics(rows: DataFrame) -> DataFrame:
    """Per ticker, the messages of the first kind of topic that has any."""
    place = F.lit(len(TOPIC_ORDER))
    for k, kind in reversed(list(enumerate(TOPIC_ORDER))):
        place = F.when(F.startswith("topic", F.lit(f"{kind}_")), k).otherwise(place)
    return ranking.first_available(rows, ["ticker"], place)


def online_features(landed: DataFrame, names: list[str], lookback: int = 200, newest: bool = True) -> DataFrame:
    """Latest feature row per ticker from landed messages of its preferred kind of topic."""
    quotes = landed.where("interval <> 'tick'")
    if "topic" in landed.columns:
        quotes = preferred_topics(quotes)
    recent = topics.bounded_read(quotes, lookback + 250, newest)
    timed = recent.withColumn("ts", X.parse_timestamp(F.col("timestamp"))).where("ts is not null")
    order = topics.arrival(timed.columns)[1:]
    unique = clean.keep_last(timed.select("ticker", "ts", F.struct(*order).alias("_arrival"), "open", "high", "low", "close", "volume"),
                             ["ticker", "ts"], "_arrival").drop("_arrival")
    frame = features.inference_frame(unique, lookback, order="ts")
    return columns.project_features(clean.latest(frame, ["ticker"], "ts"), names, keep=("ticker", "ts"))
