"""Queries: continuous jobs, run over the tables as staged files until everything is processed."""

import time

from pyspark.sql import functions as F

from tapework.catalog.base import PRICES, query, rounded, rsql, using
from tapework.catalog.features import LAG_SQL, MEAN_SQL, NAMES, SERVED, STD_SQL
from tapework.functions import scalar as X
from tapework.session import scratch
from tapework.sources import topics
from tapework.sources.fixtures import messages, ticks
from tapework.streaming import candles as C
from tapework.streaming import expiry, latency, online, upkeep

NTZ = "timestamp_ntz"
CHUNKS = 4
#: Messages of a file, and the files of a micro-batch: of jobs that only Spark's own operators run, and of
#: those that hold a key's messages of a micro-batch in Python.
FILE_ROWS = 1 << 16
FILES = 64
PYTHON_FILES = 16


def in_order(spark, path):
    """Give the files of one job the times of their order, in which a stream takes them."""
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = home.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [e.getPath() for e in system.listStatus(home) if e.getPath().getName().startswith("part-")]
    now = int(time.time()) - len(files)
    for k, file in enumerate(sorted(files, key=lambda f: int(f.getName().split("-")[1]))):
        system.setTimes(file, (now + k) * 1000, -1)


def staged(spark, sf, rows=None, broken=False, files=FILES, order=None):
    """Messages as topic records, written as files that follow ``order`` (their time, unless given); messages
    of equal order share a file."""
    rows = messages(spark, sf) if rows is None else rows
    value = F.to_json(F.struct(*topics.FIELDS))
    if broken:
        rest = [c for c in topics.FIELDS if c != "volume"]
        case = F.col("offset") % 10
        value = (F.when(case == 0, F.lit("not json")).when(case == 1, F.to_json(F.struct("timestamp", "close")))
                 .when(case == 2, F.to_json(F.struct(*rest, F.lit("NaN").alias("volume"))))
                 .when(case == 3, F.to_json(F.struct(*rest, F.lit("1e30").alias("volume")))).otherwise(value))
    parts = max(CHUNKS, -(-rows.count() // FILE_ROWS))
    order = X.parse_timestamp(F.col("timestamp")) if order is None else F.col(order)
    path = scratch(spark, "topic")
    rows.repartitionByRange(parts, order).select(
        F.col("ticker").alias("key"), value.alias("value"), "topic", "partition", "offset").write.parquet(path)
    in_order(spark, path)
    return C.from_files(spark, path, files_per_trigger=files)


def paths(spark, *names):
    return [scratch(spark, n) for n in (*names, "checkpoint")]


@query("stream_decode", using("messages", """SELECT topic, partition, "offset", ticker, "timestamp", period, "interval", open, high,
    low, close, volume FROM messages"""))
def stream_decode(spark, sf):
    out, chk = paths(spark, "landed")
    C.land(staged(spark, sf), out, chk).awaitTermination()
    return spark.read.parquet(out)


@query("stream_quarantine", using("messages", """SELECT 'good' AS sink, count(*) AS rows, sum("offset")::BIGINT AS offsets FROM messages
    WHERE "offset" % 10 > 3 UNION ALL SELECT 'bad', count(*), sum("offset")::BIGINT FROM messages WHERE "offset" % 10 <= 3"""))
def stream_quarantine(spark, sf):
    good, bad, chk = paths(spark, "good", "bad")
    C.quarantine(staged(spark, sf, broken=True), good, bad, chk).awaitTermination()
    count = lambda p, n: spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows"), F.sum("offset").alias("offsets")).select(
        F.lit(n).alias("sink"), "rows", "offsets")
    return count(good, "good").unionByName(count(bad, "bad"))


# Every message is delivered twice in a row; quotes are compared with the latest candle's close.
@query("stream_suppress", using("messages", """SELECT ticker, "timestamp", "interval", close, "offset" FROM (SELECT *,
    last_value(CASE WHEN "interval" <> 'tick' THEN "timestamp" END IGNORE NULLS) OVER w AS old_time,
    last_value(CASE WHEN "interval" <> 'tick' THEN close END IGNORE NULLS) OVER w AS old_close FROM pairs
    WINDOW w AS (PARTITION BY ticker ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE NOT coalesce(CASE WHEN "interval" = 'tick' THEN close = old_close
        ELSE "timestamp" = old_time AND abs(close - old_close) < 1e-12 END, false)""",
    pairs="""SELECT ticker, "timestamp", "interval", close, "offset" * 2 AS "offset" FROM messages UNION ALL
    SELECT ticker, "timestamp", "interval", close, "offset" * 2 + 1 FROM messages"""))
def stream_suppress(spark, sf):
    one = messages(spark, sf).withColumn("offset", F.col("offset") * 2)
    pairs = one.unionByName(one.withColumn("offset", F.col("offset") + 1))
    out, chk = paths(spark, "changed")
    decoded = topics.decode(staged(spark, sf, pairs, files=PYTHON_FILES, order="offset"))
    C.to_table(C.suppressed(decoded), out, chk).awaitTermination()
    return spark.read.parquet(out)


LATEST = """SELECT ticker, period, "interval", "offset", "timestamp", close FROM messages
    QUALIFY row_number() OVER (PARTITION BY ticker, period, "interval" ORDER BY event_ts DESC, topic DESC, partition DESC, "offset" DESC) = 1"""


def latest_table(spark, records):
    out, chk = paths(spark, "latest")
    return out, C.keep_latest(topics.decode(records), out, chk)


@query("stream_latest", using("messages", LATEST))
def stream_latest(spark, sf):
    out, q = latest_table(spark, staged(spark, sf))
    q.awaitTermination()
    return C.read_latest(spark, out).select("ticker", "period", "interval", "offset", "timestamp", "close")


@query("stream_ttl_latest", using("messages", """SELECT ticker, period, "interval", close, ttl FROM (SELECT *, row_number() OVER (
    PARTITION BY ticker, period, "interval" ORDER BY event_ts DESC, topic DESC, partition DESC, "offset" DESC) AS k FROM messages) CROSS JOIN (VALUES (60), (300), (3600)) t(ttl)
    WHERE k = 1 AND (SELECT max(event_ts) FROM messages) - event_ts < to_seconds(ttl)"""))
def stream_ttl_latest(spark, sf):
    out, q = latest_table(spark, staged(spark, sf))
    q.awaitTermination()
    now = F.lit(ticks(spark, sf).agg(F.max("ts")).first()[0])
    parts = [C.read_fresh(spark, out, now, s).select("ticker", "period", "interval", "close", F.lit(s).alias("ttl"))
             for s in (C.LATEST_TTL, C.CACHE_TTL, 3600)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def candle_sql(width, keys, views="messages"):
    k = ", ".join(keys)
    order = 'event_ts, topic, partition, "offset"'
    return f"""SELECT {k}, bucket, first(open ORDER BY {order}) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY {order}) AS close,
        CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT *, CAST(date_trunc('{width}', event_ts) AS TIMESTAMP) AS bucket FROM m)
        WHERE bucket + INTERVAL 1 {width} <= (SELECT max(event_ts) FROM messages) - INTERVAL 1 HOUR GROUP BY {k}, bucket"""


@query("stream_ohlc", using("messages", candle_sql("day", ["ticker"]), m="SELECT * FROM messages"))
def stream_ohlc(spark, sf):
    out, chk = paths(spark, "candles")
    C.to_table(C.candles(C.with_event_time(topics.decode(staged(spark, sf))), "1 day"), out, chk).awaitTermination()
    return spark.read.parquet(out).withColumn("bucket", F.col("bucket").cast(NTZ))


@query("stream_tick_merge", using("messages", candle_sql("hour", ["ticker", '"interval"']),
       m="""SELECT * REPLACE (CASE WHEN "interval" = 'tick' THEN '1m' ELSE "interval" END AS "interval",
       CASE WHEN "interval" = 'tick' THEN close ELSE open END AS open, CASE WHEN "interval" = 'tick' THEN close ELSE high END AS high,
       CASE WHEN "interval" = 'tick' THEN close ELSE low END AS low, CASE WHEN "interval" = 'tick' THEN 1 ELSE volume END AS volume) FROM messages"""))
def stream_tick_merge(spark, sf):
    out, chk = paths(spark, "merged")
    folded = C.fold_ticks(C.with_event_time(topics.decode(staged(spark, sf))), "1m")
    C.to_table(C.candles(folded, "1 hour", keys=("ticker", "interval")), out, chk).awaitTermination()
    return spark.read.parquet(out).withColumn("bucket", F.col("bucket").cast(NTZ))


@query("stream_publish", using("messages", """SELECT 'price_update' AS type, ticker, '1d_' || "interval" AS partition, "offset", close
    FROM messages"""))
def stream_publish(spark, sf):
    out, chk = paths(spark, "updates")
    C.publish(topics.decode(staged(spark, sf)), out, chk).awaitTermination()
    return spark.read.parquet(out).select("type", "ticker", "partition", "offset",
                                          F.get_json_object("data", "$.close").cast("double").alias("close"))


@query("stream_dual_sink", using("messages", """SELECT 'table' AS sink, ticker, count(*) AS rows FROM messages GROUP BY 2
    UNION ALL SELECT 'topic', ticker, 2 * count(*) FROM messages GROUP BY 2"""))
def stream_dual_sink(spark, sf):
    """Every message arrives twice: the table keeps one row per key, the topic gets both."""
    one = messages(spark, sf).withColumn("offset", F.col("offset") * 2)
    pairs = one.unionByName(one.withColumn("offset", F.col("offset") + 1))
    table, updates, chk = paths(spark, "daily", "topic_out")
    C.dual_sink(C.with_event_time(topics.decode(staged(spark, sf, pairs))), table, updates, chk, mode=None).awaitTermination()
    stored = spark.read.parquet(table).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")).withColumn("sink", F.lit("table"))
    sent = spark.read.parquet(updates).groupBy(F.col("key").alias("ticker")).agg(
        F.count(F.lit(1)).alias("rows")).withColumn("sink", F.lit("topic"))
    return stored.unionByName(sent)


@query("stream_status", using("messages", """SELECT 'stopped' AS status, CAST(NULL AS VARCHAR) AS mode, count(*) AS input_rows,
    count(DISTINCT ticker) AS tickers, count(DISTINCT ticker) AS cached_tickers FROM messages"""))
def stream_status(spark, sf):
    records = staged(spark, sf)
    out, q = latest_table(spark, records)
    q.awaitTermination()
    landed, chk = paths(spark, "landed")
    C.land(records, landed, chk).awaitTermination()
    return C.status(q, spark, "instant", messages(spark, sf), C.read_latest(spark, out), spark.read.parquet(landed))


# Every message is consumed user_id % 977 milliseconds after it was produced.
@query("stream_latency", using("messages", """SELECT ticker, count(*) AS messages, CAST(floor(quantile_cont(d, 0.5)) AS BIGINT) AS p50_ms,
    CAST(floor(quantile_cont(d, 0.95)) AS BIGINT) AS p95_ms, CAST(floor(quantile_cont(d, 0.99)) AS BIGINT) AS p99_ms
    FROM (SELECT ticker, volume % 977 AS d FROM messages) GROUP BY 1"""))
def stream_latency(spark, sf):
    out, chk = paths(spark, "timed")
    timed = C.with_event_time(topics.decode(staged(spark, sf)))
    stamped = C.consumed(timed, F.timestamp_millis(F.unix_millis("ts") + F.col("volume") % 977))
    C.to_table(stamped, out, chk).awaitTermination()
    return C.latency_rows(spark.read.parquet(out))


# Clicks come by an instant and a daily topic, purchases by an hourly and a daily one, errors daily, others instant.
PLACE = """CASE WHEN ticker = 'error' THEN 2 WHEN ticker = 'purchase' THEN CASE WHEN "offset" % 3 = 0 THEN 1 ELSE 2 END
    WHEN ticker = 'click' THEN CASE WHEN "offset" % 2 = 0 THEN 0 ELSE 2 END ELSE 0 END"""


def spread(rows):
    even, third = F.col("offset") % 2 == 0, F.col("offset") % 3 == 0
    kind = (F.when(F.col("ticker") == "error", "daily").when(F.col("ticker") == "purchase", F.when(third, "hourly").otherwise("daily"))
            .when(F.col("ticker") == "click", F.when(even, "instant").otherwise("daily")).otherwise("instant"))
    return rows.withColumn("topic", F.concat_ws("_", kind, F.lower("ticker")))


# The newest 450 candle messages per ticker, one row per time, then the serving features' last row.
ONLINE = {
    "recent": f"""SELECT ticker, event_ts AS date, open, high, low, close, volume FROM (SELECT * FROM (SELECT *, {PLACE} AS place
        FROM messages WHERE "interval" <> 'tick') QUALIFY place = min(place) OVER (PARTITION BY ticker))
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY event_ts DESC, topic DESC, partition DESC, "offset" DESC) <= 450""",
    "rlog": "SELECT *, " + ", ".join(f"ln(nullif({p}, 0)) AS {p}_log" for p in PRICES) + " FROM recent",
    "ret": "SELECT *, " + ", ".join(
        f"coalesce({p}_log - lag({p}_log) OVER (PARTITION BY ticker ORDER BY date), 0.0) AS {p}_log_return" for p in PRICES) + " FROM rlog",
    "raw_frame": f"SELECT *, {LAG_SQL}, {MEAN_SQL}, {STD_SQL} FROM ret",
    "filled": "SELECT ticker, date AS ts, " + ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0.0) AS {c}"
        for c in SERVED) + " FROM raw_frame",
}


@query("online_features", using("messages", f"""SELECT ticker, ts, {rsql(NAMES)} FROM filled
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1""", **ONLINE))
def online_features(spark, sf):
    out, chk = paths(spark, "landed")
    C.land(staged(spark, sf, spread(messages(spark, sf))), out, chk).awaitTermination()
    rows = C.online_features(spark.read.parquet(out), NAMES)
    return rounded(rows, NAMES).withColumn("ts", F.col("ts").cast(NTZ))


# Every candle message's own feature row; offsets follow the times, and no ticker has a time twice.
MESSAGE_ROWS = {
    "recent": """SELECT ticker, event_ts AS date, open, high, low, close, "offset" FROM messages WHERE "interval" <> 'tick'
        QUALIFY row_number() OVER (PARTITION BY ticker, event_ts ORDER BY "offset" DESC) = 1""",
    "rlog": ONLINE["rlog"], "ret": ONLINE["ret"], "raw_frame": ONLINE["raw_frame"],
    "filled": ONLINE["filled"].replace("date AS ts,", "date AS ts, \"offset\",", 1),
}


@query("stream_features", using("messages", f"""SELECT ticker, ts, "offset", {rsql(NAMES)} FROM filled""", **MESSAGE_ROWS))
def stream_features(spark, sf):
    out, chk = paths(spark, "features")
    timed = C.with_event_time(topics.decode(staged(spark, sf, files=PYTHON_FILES)))
    C.to_table(online.message_features(timed, NAMES), out, chk).awaitTermination()
    return rounded(spark.read.parquet(out), NAMES).withColumn("ts", F.col("ts").cast(NTZ))


# The same delays as above, by buckets of their eight leading bits and nearest ranks.
@query("stream_latency_buckets", using("messages", """SELECT ticker, any_value(n) AS messages, """ + ", ".join(
    f"min(CASE WHEN k >= ceil(n * {p}) THEN b END) AS p{round(p * 100)}_ms" for p in (0.5, 0.95, 0.99)) + """ FROM (SELECT ticker, b,
    row_number() OVER (PARTITION BY ticker ORDER BY b) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM (SELECT ticker,
    (d >> greatest(length(bin(d)) - 8, 0)) << greatest(length(bin(d)) - 8, 0) AS b FROM (SELECT ticker, volume % 977 AS d FROM messages)))
    GROUP BY 1"""))
def stream_latency_buckets(spark, sf):
    out, chk = paths(spark, "delays")
    timed = C.with_event_time(topics.decode(staged(spark, sf)))
    latency.keep_counts(C.consumed(timed, F.timestamp_millis(F.unix_millis("ts") + F.col("volume") % 977)), out, chk).awaitTermination()
    return latency.percentiles(latency.read_counts(spark, out))


# Slots whose last message is less than an hour older than the newest of all.
@query("stream_expiry", using("messages", """SELECT ticker, period, "interval", "offset", close FROM messages QUALIFY row_number() OVER (
    PARTITION BY ticker, period, "interval" ORDER BY event_ts DESC, topic DESC, partition DESC, "offset" DESC) = 1
    AND max(event_ts) OVER () - event_ts < to_seconds(3600)"""))
def stream_expiry(spark, sf):
    out, chk = paths(spark, "changes")
    timed = C.with_event_time(topics.decode(staged(spark, sf)))
    expiry.keep_changes(timed, out, chk, seconds=3600).awaitTermination()
    return expiry.alive(upkeep.Sink(spark, out).read()).select("ticker", "period", "interval", "offset", "close")


@query("stream_compact", using("messages", """SELECT 'price_update' AS type, ticker, '1d_' || "interval" AS partition, "offset", close
    FROM messages"""))
def stream_compact(spark, sf):
    """The updates sink after two compactions: the rows of its micro-batches in one table."""
    out, chk = paths(spark, "updates")
    C.publish(topics.decode(staged(spark, sf)), out, chk).awaitTermination()
    sink = upkeep.Sink(spark, out)
    sink.compact(open_batches=1)
    sink.compact(open_batches=0)
    return sink.read().select("type", "ticker", "partition", "offset", F.get_json_object("data", "$.close").cast("double").alias("close"))
