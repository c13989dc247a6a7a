"""Message topics: options, encoding, bounded reads and inventory.

A topic is read with Spark's ``kafka`` source where its package is installed; the functions below
work on the columns that source yields (key, value, topic, partition, offset), from any store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapework import schemas as S
from tapework.functions import scalar as X
from tapework.operators import series as R

FIELDS = ("ticker", "timestamp", "period", "interval", "open", "high", "low", "close", "volume")

RECORD = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
])


def kafka_options(servers: str, topics: list[str], newest: bool = False) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics),
            "startingOffsets": "latest" if newest else "earliest"}


def read_topics(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """Whole retained content of the topics, as a batch."""
    reader = spark.read.format("kafka").options(**kafka_options(servers, topics), endingOffsets="latest")
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"),
                                "topic", "partition", "offset")


def write_topic(messages: DataFrame, servers: str, partitions: int = 16) -> None:
    """Keyed JSON publish, acknowledged by all replicas, partition fixed by the key's checksum."""
    (encode(messages).withColumn("partition", X.topic_partition(F.col("key"), partitions))
     .write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").save())


def encode(messages: DataFrame) -> DataFrame:
    """``topic, key, value`` records; missing fields are left out of the JSON."""
    fields = [c for c in FIELDS if c in messages.columns]
    return messages.select("topic", F.col("ticker").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def decode(records: DataFrame) -> DataFrame:
    """Payload fields with both spellings accepted, missing prices 0, period 1d and interval 1m by default.

    Undecodable payloads keep their row with a NULL ticker, and a price or volume that is no finite
    number (or does not fit) is NULL, so a caller can set such rows aside.
    """
    # One parse gives the raw fields; a second projection cleans them, each named once, so that both stay
    # small enough to be compiled.
    spelled = [*FIELDS, "date", *(n.title() for n in (*S.PRICES, "volume"))]
    raw = {n: f"_{k}" for k, n in enumerate(spelled)}
    kept = [c for c in records.columns if c not in ("key", "value")]
    given = records.select(*kept, F.col("value").alias("payload"), F.json_tuple("value", *spelled).alias(*raw.values()))
    cleaned = given.select(*kept, "payload", *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.values()])

    def text(*names):
        return F.coalesce(*[F.col(raw[n]) for n in names])

    texts = cleaned.select(*kept, "payload", text("ticker").alias("ticker"), text("timestamp", "date").alias("timestamp"),
                           F.coalesce(text("period"), F.lit("1d")).alias("period"), F.coalesce(text("interval"), F.lit("1m")).alias("interval"),
                           *[F.coalesce(text(n, n.title()), F.lit("0")).try_cast("double").alias(n) for n in (*S.PRICES, "volume")])
    return texts.withColumns({**{p: X.inf_to_null(F.col(p)) for p in S.PRICES}, "volume": X.inf_to_null(F.col("volume")).try_cast("bigint")})


def is_well_formed(decoded: DataFrame) -> Column:
    """A ticker, a time, and numbers that are numbers, as far as the frame has these columns."""
    good = F.lit(True)
    for name in ("ticker", "timestamp", *S.PRICES, "volume"):
        if name in decoded.columns:
            good = good & F.col(name).isNotNull()
    return good


def well_formed(decoded: DataFrame) -> DataFrame:
    return decoded.where(is_well_formed(decoded))


def arrival(columns: list[str]) -> list[str]:
    """Columns that order messages over several topics: offsets compare only inside a partition."""
    return [c for c in ("ts", "topic", "partition", "offset") if c in columns]


def bounded_read(decoded: DataFrame, n: int, newest: bool = True) -> DataFrame:
    """At most ``n`` records per ticker, the newest (default) or the oldest, by time, topic, partition
    and offset. Records whose time cannot be read count as the oldest."""
    if "timestamp" not in decoded.columns:
        timed, drop = decoded, []
    else:
        drop = [] if "ts" in decoded.columns else ["ts"]
        timed = decoded.withColumn("ts", F.coalesce(X.parse_timestamp(F.col("timestamp")), F.timestamp_seconds(F.lit(0))))
    order = arrival(timed.columns)
    if newest:
        return R.tail(timed, ["ticker"], order, n).drop(*drop)
    back = {"ts": -F.unix_micros("ts") if "ts" in timed.columns else None, "partition": -F.col("partition"), "offset": -F.col("offset")}
    flipped = timed.withColumns({f"_{c}": back.get(c, F.col(c)) for c in order})
    width = R.SLOT_SECONDS * 1_000_000 if order[0] == "ts" else None
    return R.tail(flipped, ["ticker"], [f"_{c}" for c in order], n, slot_width=width).drop(*drop, *[f"_{c}" for c in order])


def latest_read(decoded: DataFrame, n: int) -> DataFrame:
    """The retry from the end of a topic, never more than 50 records."""
    return bounded_read(decoded, min(50, n))


def inventory(records: DataFrame, prefix: str | None = None) -> DataFrame:
    """Topics with their number of partitions, and a total row (NULL topic)."""
    rows = records if prefix is None else records.where(F.startswith("topic", F.lit(prefix)))
    counted = rows.select("topic", "partition").distinct().groupBy("topic").agg(
        F.count(F.lit(1)).alias("partitions"))
    return counted.rollup("topic").agg(F.sum("partitions").alias("partitions"))
