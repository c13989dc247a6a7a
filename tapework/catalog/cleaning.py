"""Queries: calendar, fills, duplicates, outliers and resampling."""

from pyspark.sql import functions as F

from tapework.catalog.base import PRICES, query, rounded, rsql, using
from tapework.functions import scalar as X
from tapework.operators import clean, resample, series as R
from tapework.operators.features import plain
from tapework.schemas import MAX_POINTS
from tapework.session import materialize
from tapework.sources.fixtures import bars, messages, ticks

NTZ = "timestamp_ntz"


@query("calendar_align", using("panel", "SELECT ticker, date, open, high, low, close, volume FROM panel"))
def calendar_align(spark, sf):
    return plain(clean.align(bars(spark, sf))).select("ticker", "date", *PRICES, "volume")


BEFORE = "(PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
AFTER = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("ffill", using("panel", "SELECT ticker, date, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER {BEFORE} AS {c}" for c in PRICES) + " FROM panel"))
def ffill(spark, sf):
    return clean.ffill(clean.align(bars(spark, sf)), PRICES).select("ticker", "date", *PRICES)


@query("bfill", using("panel", "SELECT ticker, date, " + ", ".join(
    f"first_value({c} IGNORE NULLS) OVER {AFTER} AS {c}" for c in PRICES) + " FROM panel"))
def bfill(spark, sf):
    return clean.bfill(clean.align(bars(spark, sf)), PRICES).select("ticker", "date", *PRICES)


@query("fill_chain", using("panel", "SELECT ticker, date, " + ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER {BEFORE}, first_value({c} IGNORE NULLS) OVER {AFTER}, 0.0) AS {c}"
    for c in PRICES) + " FROM panel"))
def fill_chain(spark, sf):
    return clean.fill_chain(clean.align(bars(spark, sf)), PRICES).select("ticker", "date", *PRICES)


@query("dedup_keep_last", using("doubled", """SELECT ticker, event_ts AS ts, "offset", close FROM doubled
    QUALIFY row_number() OVER (PARTITION BY ticker, event_ts ORDER BY "offset" DESC) = 1"""))
def dedup_keep_last(spark, sf):
    rows = messages(spark, sf, doubled=True).select(
        "ticker", X.parse_timestamp(F.col("timestamp")).alias("ts"), "offset", "close")
    return clean.keep_last(rows, ["ticker", "ts"], "offset").withColumn("ts", F.col("ts").cast(NTZ))


# Both deliveries of a record follow each other here, so every second one is unchanged.
@query("suppress_unchanged", using("messages", """SELECT ticker, "timestamp", close, arrival FROM (SELECT *,
    coalesce(lag("timestamp") OVER w = "timestamp" AND abs(lag(close) OVER w - close) < 1e-12, false) AS same
    FROM pairs WINDOW w AS (PARTITION BY ticker ORDER BY arrival)) WHERE NOT same""",
    pairs="""SELECT ticker, "timestamp", close, "offset" * 2 AS arrival FROM messages UNION ALL
    SELECT ticker, "timestamp", close, "offset" * 2 + 1 FROM messages"""))
def suppress_unchanged(spark, sf):
    one = messages(spark, sf).select("ticker", "timestamp", "close", (F.col("offset") * 2).alias("arrival"))
    pairs = one.unionByName(one.withColumn("arrival", F.col("arrival") + 1))
    return clean.suppress_unchanged(pairs, arrival="arrival").select("ticker", "timestamp", "close", "arrival")


@query("index_gaps", using("bars", """SELECT date, CAST(days AS INTEGER) AS days FROM (SELECT date,
    date_diff('day', lag(date) OVER (ORDER BY date), date) AS days FROM (SELECT DISTINCT date FROM bars)) WHERE days > 1"""))
def index_gaps(spark, sf):
    return clean.index_gaps(bars(spark, sf))


@query("continuity_check", using("bars", """SELECT ticker, previous, date, CAST(date_diff('day', previous, date) AS INTEGER) AS days
    FROM (SELECT ticker, date, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS previous FROM bars)
    WHERE date_diff('day', previous, date) > 2"""))
def continuity_check(spark, sf):
    return clean.gaps(bars(spark, sf))


Z = [f"{c}_z" for c in PRICES]
ZSQL = "SELECT *, " + ", ".join(
    f"({c} - avg({c}) OVER t) / nullif(stddev_pop({c}) OVER t, 0) AS {c}_z" for c in PRICES) + (
    " FROM bars WINDOW t AS (PARTITION BY ticker)")


@query("zscore", using("bars", f"SELECT ticker, date, {rsql(Z)} FROM z", z=ZSQL))
def zscore(spark, sf):
    return rounded(clean.zscore(bars(spark, sf), PRICES).select("ticker", "date", *Z), Z)


# Synthetic prices are evenly spread and hold no value beyond 3 deviations; 1.5 gives flags to compare.
FLAGS = ", ".join(f"CAST(coalesce(abs({c}_z) > 1.5, false) AS INTEGER) AS {c}_is_outlier" for c in PRICES)


@query("outlier_flags", using("bars", f"SELECT ticker, date, {FLAGS} FROM z", z=ZSQL))
def outlier_flags(spark, sf):
    return clean.outlier_flags(bars(spark, sf), limit=1.5).select("ticker", "date", *[f"{c}_is_outlier" for c in PRICES])


@query("outlier_counts", using("bars", " UNION ALL ".join(
    f"SELECT ticker, '{c}' AS price_type, CAST(count(*) FILTER (abs({c}_z) > 1.5) AS BIGINT) AS outliers FROM z GROUP BY ticker"
    for c in PRICES), z=ZSQL))
def outlier_counts(spark, sf):
    return clean.outlier_counts(bars(spark, sf), limit=1.5)


@query("outlier_rows", using("bars", "SELECT ticker, date, open, high, low, close FROM z WHERE "
                             + " OR ".join(f"abs({c}_z) > 1.5" for c in PRICES), z=ZSQL))
def outlier_rows(spark, sf):
    return clean.outlier_rows(bars(spark, sf), limit=1.5).select("ticker", "date", *PRICES)


def bucket_sql(step, ts="ts"):
    return f"date_trunc('hour', {ts}) + to_minutes(CAST((minute({ts}) // {step}) * {step} AS INTEGER))"


# 7 minutes does not divide an hour: buckets restart on the hour.
@query("time_bucket", using("ticks", f"""SELECT seq, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, date_trunc('hour', ts) AS hour,
    {bucket_sql(5)} AS five, {bucket_sql(7)} AS seven FROM ticks"""))
def time_bucket(spark, sf):
    b = lambda i: resample.time_bucket(F.col("ts"), i).cast(NTZ)
    return ticks(spark, sf).select("seq", b("1d").alias("day"), b("1h").alias("hour"), b("5m").alias("five"), b("7m").alias("seven"))


@query("bucket_last", using("ticks", """SELECT ticker, date_trunc('hour', ts) AS bucket, arg_max(price, seq) AS price
    FROM ticks GROUP BY 1, 2"""))
def bucket_last(spark, sf):
    return resample.bucket_last(ticks(spark, sf), "1h").withColumn("bucket", F.col("bucket").cast(NTZ))


def _ohlc(interval, expression):
    return f"""SELECT '{interval}' AS "interval", ticker, CAST({expression} AS TIMESTAMP) AS bucket, arg_min(price, seq) AS open,
        max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, count(*) AS volume FROM ticks GROUP BY ticker, 3"""


@query("ohlc_resample", using("ticks", " UNION ALL ".join([
    _ohlc("5m", bucket_sql(5)), _ohlc("1h", "date_trunc('hour', ts)"), _ohlc("1d", "date_trunc('day', ts)"),
    _ohlc("1wk", "date_trunc('week', ts)"), _ohlc("1mo", "date_trunc('month', ts)")])))
def ohlc_resample(spark, sf):
    # Trades are read once; the coarser candles come from the five-minute ones.
    fine = materialize(resample.resample(ticks(spark, sf), "5m"), "candles")
    out = fine.withColumn("interval", F.lit("5m"))
    for i in ("1h", "1d", "1wk", "1mo"):
        out = out.unionByName(resample.coarsen(fine, i, order="bucket").withColumn("interval", F.lit(i)))
    return out.withColumn("bucket", F.col("bucket").cast(NTZ))


@query("retention_trim", using("ticks", """SELECT ticker, ts, seq, price FROM ticks
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, seq DESC) <= least(6000, ceil(1440 / 5))"""))
def retention_trim(spark, sf):
    rows = ticks(spark, sf).select("ticker", "ts", "seq", "price")
    cap = X.max_points(F.lit("1d"), F.lit("5m"))
    return R.tail(rows, ["ticker"], ["ts", "seq"], cap, most=MAX_POINTS).withColumn("ts", F.col("ts").cast(NTZ))


@query("retention_caps", using("messages", """SELECT period, "interval", CASE WHEN "interval" = 'tick' THEN 2000
    ELSE CAST(least(6000, ceil(1440 / 1)) AS INTEGER) END AS points, count(*) AS rows FROM messages GROUP BY 1, 2"""))
def retention_caps(spark, sf):
    caps = X.max_points(F.col("period"), F.col("interval")).alias("points")
    return messages(spark, sf).groupBy("period", "interval", caps).agg(F.count(F.lit(1)).alias("rows"))


@query("last_points", using("bars", """SELECT ticker, date, close, max_by(close, date) OVER (PARTITION BY ticker) AS latest_price
    FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 30"""))
def last_points(spark, sf):
    rows = bars(spark, sf).select("ticker", "date", "close")
    last = rows.groupBy("ticker").agg(F.max_by("close", "date").alias("latest_price"))
    return R.tail(rows, ["ticker"], ["date"], 30).join(last, "ticker").select("ticker", "date", "close", "latest_price")


@query("tail_rows", using("bars", """SELECT ticker, date, open, high, low, close, volume FROM bars
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= least(200, 250)"""))
def tail_rows(spark, sf):
    return R.tail(bars(spark, sf), ["ticker"], ["date"], min(200, 250)).select("ticker", "date", *PRICES, "volume")


@query("history_tail", using("bars", """SELECT ticker, date, open, high, low, close, volume FROM bars
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 450"""))
def history_tail(spark, sf):
    return R.tail(bars(spark, sf), ["ticker"], ["date"], 200 + 250).select("ticker", "date", *PRICES, "volume")
