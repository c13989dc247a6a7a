"""Queries: scans, sinks, topics and the registry."""

import zlib

from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.catalog.backtests import preds
from tapework.catalog.features import SEQUENCE_SQL, rounded_sequences
from tapework.catalog.base import PRICES, grade_sql, query, r, rnd, rsql, using
from tapework.functions import scalar as X
from tapework.operators import backtest, columns as C, features, quality, ranking
from tapework.operators import series as R
from tapework.session import scratch
from tapework.sources import files, registry, tables, topics
from tapework.sources.fixtures import bars, messages

DAY = "2024-01-31"
BAR_SQL = "SELECT ticker, date, open, high, low, close, close AS adj_close, volume FROM bars"


def full_bars(spark, sf):
    return C.conform(bars(spark, sf).withColumn("adj_close", F.col("close")))


def landed(spark, sf):
    return files.land_raw(full_bars(spark, sf), scratch(spark, "landing"), DAY)


@query("csv_scan_bars", using("bars", BAR_SQL))
def csv_scan_bars(spark, sf):
    return files.read_raw(spark, landed(spark, sf))


MIXED = """SELECT ticker, date, CASE WHEN k = 2 THEN NULL ELSE open END AS open, high, low, close,
    CASE WHEN k = 0 THEN close END AS adj_close, CASE WHEN k = 1 THEN NULL ELSE volume END AS volume
    FROM (SELECT *, CAST(o AS INTEGER) % 3 AS k FROM (SELECT *, substr(ticker, 1, 1) AS o FROM bars))"""


@query("csv_scan_mixed", using("bars", MIXED))
def csv_scan_mixed(spark, sf):
    """One tree whose files differ in columns, their order and the name of the date."""
    rows, path = full_bars(spark, sf), scratch(spark, "mixed")
    shapes = {0: ("Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"), 1: ("Close", "Datetime", "Low", "High", "Open"),
              2: ("timestamp", " HIGH ", "low", "close", "Volume")}
    for k, names in shapes.items():
        kind = lambda n: n.strip().lower().replace(" ", "_").replace("datetime", "date").replace("timestamp", "date")
        part = rows.where(F.substring("ticker", 1, 1).cast("int") % 3 == k)
        # Volumes are written as decimals, as some feeds do.
        cells = [(F.col(kind(n)).cast("double") if kind(n) == "volume" else F.col(kind(n))).alias(n) for n in names]
        part.select("ticker", *cells).write.partitionBy("ticker").option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).mode("append").csv(f"{path}/raw")
    return files.read_raw(spark, f"{path}/raw")


@query("raw_landing", using("bars", f"SELECT ticker, '{DAY}' AS ingest_date, count(*) AS rows FROM bars GROUP BY 1"))
def raw_landing(spark, sf):
    path = landed(spark, sf)
    found = spark.read.schema("Date string, Open string, High string, Low string, Close string, `Adj Close` string, "
                              "Volume string, ticker string, ingest_date string").option("header", True).csv(path)
    return found.groupBy("ticker", "ingest_date").agg(F.count(F.lit(1)).alias("rows"))


@query("path_ticker", using("bars", "SELECT ticker, count(*) AS rows FROM bars GROUP BY 1"))
def path_ticker(spark, sf):
    rows = (spark.read.schema(S.RAW_CSV).option("header", True).option("recursiveFileLookup", True).csv(landed(spark, sf))
            .select(files.path_ticker(F.col("_metadata.file_path")).alias("ticker")))
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


@query("partitioned_write", using("bars", BAR_SQL))
def partitioned_write(spark, sf):
    path = scratch(spark, "bars")
    rows = full_bars(spark, sf)
    files.write_bars(rows, path)
    files.write_bars(rows, path)  # a rerun replaces its partitions
    return files.read_bars(spark, path)


def halves(spark, sf):
    """Stored bars before 1999 and an incoming batch from 1998 on with closes raised by one."""
    rows = full_bars(spark, sf)
    return rows.where("date < '1999-01-01'"), rows.where("date >= '1998-01-01'").withColumn("close", F.col("close") + 1)


UPSERTED = """SELECT ticker, date, open, high, low, CASE WHEN date >= DATE '1998-01-01' THEN close + 1 ELSE close END AS close,
    close AS adj_close, volume FROM bars"""


@query("upsert_bars", using("bars", UPSERTED))
def upsert_bars(spark, sf):
    stored, batch = halves(spark, sf)
    path = scratch(spark, "table")
    files.write_bars(stored, path)
    tables.upsert_bars(batch, path)
    return files.read_bars(spark, path)


@query("upsert_versioned", using("bars", UPSERTED))
def upsert_versioned(spark, sf):
    stored, batch = halves(spark, sf)
    path = scratch(spark, "versions")
    tables.upsert_versioned(stored, path)
    tables.upsert_versioned(batch, path)
    return tables.read_versioned(spark, path)


@query("insert_ignore", using("bars", """SELECT ticker, date, close + 1 AS close FROM bars WHERE date >= DATE '1999-01-01'"""))
def insert_ignore(spark, sf):
    stored, batch = halves(spark, sf)
    return tables.insert_ignore(stored, batch).select("ticker", "date", "close")


@query("sql_append", using("bars", BAR_SQL))
def sql_append(spark, sf):
    """Append into a Parquet table in two batches; a database takes the same frame over JDBC."""
    path = scratch(spark, "append")
    rows = full_bars(spark, sf)
    rows.where("year(date) < 1998").write.mode("append").parquet(path)
    rows.where("year(date) >= 1998").write.mode("append").parquet(path)
    return spark.read.schema(S.BAR).parquet(path)


FIELDS = "ticker, \"timestamp\", period, \"interval\", open, high, low, close, volume"


@query("bounded_topic_read", using("messages", f"""SELECT "offset", {FIELDS} FROM messages
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY event_ts DESC, topic DESC, partition DESC, "offset" DESC) <= 450"""))
def bounded_topic_read(spark, sf):
    return topics.bounded_read(decoded(spark, sf), 450).drop("topic", "partition")


@query("bounded_topic_read_oldest", using("messages", f"""SELECT "offset", {FIELDS} FROM messages
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY event_ts, topic DESC, partition, "offset") <= 450"""))
def bounded_topic_read_oldest(spark, sf):
    return topics.bounded_read(decoded(spark, sf), 450, newest=False).drop("topic", "partition")


@query("latest_topic_read", using("messages", f"""SELECT "offset", {FIELDS} FROM messages
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY event_ts DESC, topic DESC, partition DESC, "offset" DESC) <= least(50, 450)"""))
def latest_topic_read(spark, sf):
    return topics.latest_read(decoded(spark, sf), 450).drop("topic", "partition")


def records(spark, sf):
    rows = messages(spark, sf)
    fields = F.to_json(F.struct(*[c for c in topics.FIELDS]))
    return rows.select("topic", "partition", "offset", F.col("ticker").alias("key"), fields.alias("value"))


def decoded(spark, sf):
    return topics.well_formed(topics.decode(records(spark, sf))).select("topic", "partition", "offset", *topics.FIELDS)


@query("message_encode", using("messages", """SELECT topic, ticker AS key, ticker, "timestamp", close, volume FROM messages"""))
def message_encode(spark, sf):
    sent = topics.encode(messages(spark, sf))
    back = F.from_json("value", "ticker string, timestamp string, close double, volume bigint")
    return sent.select("topic", "key", back.alias("m")).select("topic", "key", "m.*")


# The tickers; the checksum itself has no SQL function.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("crc_partition", using("messages", "SELECT ticker, p.partition, count(*) AS rows FROM messages m JOIN (VALUES " + ", ".join(
    f"('{t}', {zlib.crc32(t.encode()) % 16})" for t in EVENT_TYPES) + ") p(name, partition) ON p.name = m.ticker GROUP BY 1, 2"))
def crc_partition(spark, sf):
    return messages(spark, sf).groupBy("ticker", X.topic_partition(F.col("ticker")).alias("partition")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("topic_name", """SELECT o_orderkey, 'daily_' || lower(replace(o_orderpriority || '=X', '=', '')) AS topic FROM orders""")
def topic_name(spark, sf):
    from tapework.sources.fixtures import table
    return table(spark, sf, "orders").select("o_orderkey", X.topic_name(
        F.lit("daily"), F.concat("o_orderpriority", F.lit("=X"))).alias("topic"))


@query("topic_inventory", using("messages", """SELECT topic, CAST(sum(partitions) AS BIGINT) AS partitions FROM (
    SELECT topic, count(DISTINCT partition) AS partitions FROM messages WHERE starts_with(topic, 'instant_') GROUP BY 1)
    GROUP BY ROLLUP (topic)"""))
def topic_inventory(spark, sf):
    return topics.inventory(messages(spark, sf), "instant_")


TICKERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("pivot_panel", using("bars", "SELECT date, " + ", ".join(
    f"max({p}) FILTER (ticker = '{t}') AS \"{t}_{p}\"" for t in TICKERS for p in PRICES) + " FROM bars GROUP BY 1"))
def pivot_panel(spark, sf):
    return C.pivot_panel(bars(spark, sf), TICKERS)


@query("unpivot_panel", using("bars", "SELECT date, ticker, open, high, low, close FROM bars"))
def unpivot_panel(spark, sf):
    return C.unpivot_panel(C.pivot_panel(bars(spark, sf), TICKERS), TICKERS)


BEST = f"""SELECT * FROM report_flat WHERE ic > 0.0 AND sharpe > 0.0
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY sharpe DESC, fold) = 1"""


def stored_registry(spark, sf):
    best = ranking.best_model(backtest.report(preds(spark, sf)), 0.0, 0.0)
    path = scratch(spark, "registry")
    registry.write(registry.records(best, S.training_features()), path)
    return registry.read_lines(spark, path)


METRICS = [f.name for f in S.METRICS]


@query("registry_scan", using("report_flat", f"SELECT ticker, fold, 28::BIGINT AS n_features, {rsql(METRICS)} FROM b", b=BEST))
def registry_scan(spark, sf):
    rows = stored_registry(spark, sf)
    return rows.select("ticker", "fold", F.size("features").cast("bigint").alias("n_features"),
                       *[rnd(F.col(f"metrics.{c}")).alias(c) for c in METRICS])


@query("registry_write", using("report_flat", f"""SELECT ticker, fold, 200::BIGINT AS lookback, 1::BIGINT AS horizon,
    {grade_sql()} AS performance_status, 'close_log_return_std_60' AS last_feature FROM b""", b=BEST))
def registry_write(spark, sf):
    return stored_registry(spark, sf).select("ticker", "fold", "lookback", "horizon", "performance_status",
                                             F.element_at("features", -1).alias("last_feature"))


@query("registry_summary", using("report_flat", f"""SELECT ticker AS symbol, ticker AS name, 'active' AS status,
    {r('dir_acc * 100', 1)} AS accuracy, {grade_sql()} AS performance_status, {r('mae')} AS mae, {r('rmse')} AS rmse,
    {r('sharpe', 2)} AS sharpe, {r('max_dd', 4)} AS max_dd, {r('ic', 3)} AS ic, {r('hit_rate', 3)} AS hit_rate FROM b""", b=BEST))
def registry_summary(spark, sf):
    return registry.summary(stored_registry(spark, sf))


@query("sequence_sink", SEQUENCE_SQL)
def sequence_sink(spark, sf):
    rows = R.tiled(features.positioned(bars(spark, sf)), ["ticker"], features.with_log_returns, lookback=1)
    names = [f"{p}_log_return" for p in PRICES]
    made = features.sequences(features.plain(rows.where("close_log_return is not null")), names, "close_log_return", 30, 3)
    path = scratch(spark, "sequences")
    files.write_sequences(made, path)
    return rounded_sequences(spark.read.schema(made.schema).parquet(path))


@query("row_counts", using("bars", "SELECT 'raw' AS source, count(*) AS rows FROM bars UNION ALL SELECT 'processed', count(*) FROM bars"))
def row_counts(spark, sf):
    raw = landed(spark, sf)
    path = scratch(spark, "bars")
    files.write_bars(files.read_raw(spark, raw), path)
    return quality.row_counts({"raw": spark.read.schema(S.RAW_CSV).option("header", True).csv(raw),
                               "processed": spark.read.parquet(path)})


@query("null_check", using("panel", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} IS NULL) = 0 AS passed FROM panel"
    for c in ("ticker", "date", "close"))))
def null_check(spark, sf):
    from tapework.operators import clean
    return quality.null_check(clean.align(bars(spark, sf)))


GAPS = """(SELECT count(*) FROM (SELECT date, lag(date) OVER (PARTITION BY ticker ORDER BY date) AS p FROM bars)
    WHERE date_diff('day', p, date) > 2)"""
N = "(SELECT count(*) FROM bars)"
LESS = "(SELECT count(*) FROM bars WHERE date < DATE '1999-01-01')"


@query("validate_all", using("bars", f"""SELECT * FROM (VALUES ('min_rows', {N}, 1::BIGINT, {N} >= 1),
    ('processed_within_raw', {N}, {N}, true), ('stored_covers_processed', {LESS}, {N}, {LESS} >= {N}),
    ('not_null_ticker', 0::BIGINT, 0::BIGINT, true), ('not_null_date', 0::BIGINT, 0::BIGINT, true),
    ('not_null_close', 0::BIGINT, 0::BIGINT, true), ('continuity', {GAPS.replace('FROM bars)', "FROM bars WHERE date < DATE '1999-01-01')")},
    0::BIGINT, {GAPS.replace('FROM bars)', "FROM bars WHERE date < DATE '1999-01-01')")} = 0)) v(rule, observed, bound, passed)"""))
def validate_all(spark, sf):
    rows = full_bars(spark, sf)
    raw = landed(spark, sf)
    path = scratch(spark, "bars")
    files.write_bars(rows.where("date < '1999-01-01'"), path)
    return quality.validate(spark.read.schema(S.RAW_CSV).option("header", True).csv(raw), files.read_raw(spark, raw),
                            files.read_bars(spark, path))
