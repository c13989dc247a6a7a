"""Queries: joins, latest values, stored results and fallbacks."""

from pyspark.sql import functions as F

from tapework.catalog.backtests import preds
from tapework.catalog.base import query, r, rounded, using
from tapework.operators import clean, joins, ranking
from tapework.sources.fixtures import bars, messages, table, ticks

NTZ = "timestamp_ntz"
KEYS = ["ticker", "fold"]


@query("latest_candle", using("bars", """SELECT ticker, date, open, high, low, close, volume FROM bars
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1"""))
def latest_candle(spark, sf):
    return clean.latest(bars(spark, sf), ["ticker"], "date")


# History is the ticks; live values exist for three of the five tickers, in different slots.
LIVE = """SELECT ticker, period, "interval", close, "offset" AS received FROM messages WHERE ticker IN ('click', 'view')
    AND NOT (ticker = 'view' AND "interval" = '1m')"""


@query("live_override", using("messages", f"""SELECT h.ticker, last_close, live_close, coalesce(live_close, last_close) AS latest_price
    FROM (SELECT ticker, arg_max(price, seq) AS last_close FROM ticks GROUP BY 1) h LEFT JOIN (SELECT ticker, close AS live_close
    FROM live QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN period = '1d' AND "interval" = '1m' THEN 0 ELSE 1 END,
    received) = 1) l ON l.ticker = h.ticker""", live=LIVE))
def live_override(spark, sf):
    history = ticks(spark, sf).select("ticker", F.col("seq").alias("date"), F.col("price").alias("close"))
    live = messages(spark, sf).where("ticker in ('click', 'view') and not (ticker = 'view' and interval = '1m')").withColumn(
        "received", F.col("offset"))
    return joins.live_override(history, live, "1d", "1m")


@query("batch_outcomes", using("preds", f"""SELECT q.ticker, {r('CASE WHEN s.ticker IS NOT NULL THEN pred END')} AS predicted_log_return,
    CASE WHEN s.ticker IS NULL OR pred IS NULL THEN NULL WHEN pred > 0.0001 THEN 'UP' WHEN pred < -0.0001 THEN 'DOWN' ELSE 'SIDEWAYS' END AS direction,
    CASE WHEN s.ticker IS NULL THEN 'Unsupported ticker' WHEN pred IS NULL THEN 'Features not available' END AS error
    FROM (SELECT DISTINCT ticker FROM bars UNION ALL SELECT DISTINCT o_orderstatus FROM orders) q
    LEFT JOIN (SELECT DISTINCT ticker FROM bars) s ON s.ticker = q.ticker
    LEFT JOIN (SELECT ticker, arg_max(pred, date) AS pred FROM preds WHERE ticker <> '2-HIGH' GROUP BY 1) p ON p.ticker = q.ticker"""))
def batch_outcomes(spark, sf):
    known = bars(spark, sf).select("ticker").distinct()
    strangers = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("ticker")).distinct()
    scores = preds(spark, sf).where("ticker <> '2-HIGH'").groupBy("ticker").agg(F.max_by("pred", "date").alias("pred"))
    return joins.batch_outcomes(known.unionByName(strangers), known, scores)


@query("daily_memo", using("bars", """SELECT ticker, date FROM bars WHERE (ticker, date) NOT IN (SELECT ticker, date FROM bars WHERE volume > 1)"""))
def daily_memo(spark, sf):
    rows = bars(spark, sf)
    return joins.not_yet_scored(rows.select("ticker", "date"), rows.where("volume > 1"))


@query("ttl_filter", """SELECT event_id, ts FROM events WHERE TIMESTAMP '2024-01-15 12:00:00' - ts < INTERVAL 24 HOURS""")
def ttl_filter(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts")
    return joins.fresh(rows, F.lit("2024-01-15 12:00:00").cast("timestamp"), 24 * 3600, "ts")


@query("union_folds", using("preds", f"SELECT ticker, fold, date, {r('pred')} AS pred, {r('actual')} AS actual FROM preds"))
def union_folds(spark, sf):
    made = preds(spark, sf).select(*KEYS, "date", "pred", "actual")
    out = made.where("fold = 0")
    for f in (1, 2, 3):
        out = out.unionByName(made.where(F.col("fold") == f))
    return rounded(out, ["pred", "actual"])


# Sources in priority order: 0 holds two tickers, 1 four, 2 all.
def sourced(tick_rows):
    source = F.when(F.col("ticker").isin("click", "view"), F.pmod("seq", F.lit(3))).when(
        F.col("ticker") == "error", F.lit(2)).otherwise(F.pmod("seq", F.lit(2)) + 1)
    return tick_rows.withColumn("source", source.cast("int"))


SOURCED = """SELECT *, CAST(CASE WHEN ticker IN ('click', 'view') THEN seq % 3 WHEN ticker = 'error' THEN 2 ELSE seq % 2 + 1 END AS INTEGER)
    AS source FROM ticks"""


@query("source_fallback", using("ticks", """SELECT ticker, seq, price, source FROM s
    QUALIFY source = min(source) OVER (PARTITION BY ticker)""", s=SOURCED))
def source_fallback(spark, sf):
    return ranking.first_available(sourced(ticks(spark, sf)), ["ticker"], F.col("source")).select("ticker", "seq", "price", "source")


@query("interval_fallback", using("ticks", """SELECT ticker, period, "interval", count(*) AS rows FROM (SELECT ticker,
    (['1d', '5d', '1mo'])[source + 1] AS period, (['5m', '1h', '1d'])[source + 1] AS "interval", source FROM s
    QUALIFY source = min(source) OVER (PARTITION BY ticker)) GROUP BY 1, 2, 3""", s=SOURCED))
def interval_fallback(spark, sf):
    from tapework.schemas import FALLBACK_INTERVALS
    pick = lambda i: F.element_at(F.array(*[F.lit(v[i]) for v in FALLBACK_INTERVALS]), F.col("source") + 1)
    rows = sourced(ticks(spark, sf)).withColumns({"period": pick(0), "interval": pick(1)})
    order = F.lit(None).cast("int")
    for place, (p, i) in enumerate(FALLBACK_INTERVALS):
        order = F.when((F.col("period") == p) & (F.col("interval") == i), place).otherwise(order)
    return ranking.first_available(rows, ["ticker"], order).groupBy("ticker", "period", "interval").agg(
        F.count(F.lit(1)).alias("rows"))
