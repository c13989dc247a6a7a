"""Queries: projections, filters and scalar functions."""

from pyspark.sql import functions as F

from tapework.catalog.backtests import xy
from tapework.catalog.base import PRICES, query, r, rnd, rounded, rsql, using
from tapework.functions import scalar as X
from tapework.operators import columns as C
from tapework.operators import features, joins, model, quality
from tapework.operators import series as R
from tapework.sources import topics
from tapework.sources.fixtures import bars, messages, table, ticks

NTZ = "timestamp_ntz"


def raw_frame(spark, sf):
    """Bars under the raw files' column names."""
    return bars(spark, sf).select("ticker", F.col("date").alias(" Date "), F.col("open").alias("Open"),
                                  F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"),
                                  F.col("close").alias("Adj Close"), F.col("volume").alias("Volume"))


@query("normalize_columns", using("bars", "SELECT ticker, date, open, high, low, close, close AS adj_close, volume FROM bars"))
def normalize_columns(spark, sf):
    return C.normalize_columns(raw_frame(spark, sf))


@query("date_fallback", using("ticks", "SELECT ticker, seq, price, CAST(ts AS DATE) AS date FROM ticks"))
def date_fallback(spark, sf):
    return C.with_date(ticks(spark, sf).select("ticker", F.col("ts").alias("timestamp"), "seq", "price"))


@query("canonical_select", using("bars", "SELECT ticker, date, open, high, low, close, volume FROM bars"))
def canonical_select(spark, sf):
    return C.canonical(bars(spark, sf).withColumn("note", F.lit("x")))


@query("default_ticker", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'UNKNOWN' ELSE o_orderpriority END AS ticker
    FROM orders""")
def default_ticker(spark, sf):
    found = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", C.default_ticker(found, "UNKNOWN").alias("ticker"))


@query("message_decode", using("messages", """SELECT "offset", ticker, "timestamp", period, "interval", open, high, low, close,
    volume FROM messages"""))
def message_decode(spark, sf):
    rows = messages(spark, sf)
    # Half of the records spell their fields with capitals, like some producers do.
    lower = F.struct("ticker", "timestamp", "period", "interval", *PRICES, "volume")
    upper = F.struct("ticker", "timestamp", "period", "interval", *[F.col(p).alias(p.title()) for p in (*PRICES, "volume")])
    value = F.when(F.col("offset") % 2 == 0, F.to_json(lower)).otherwise(F.to_json(upper))
    records = rows.select("topic", "partition", "offset", F.col("ticker").alias("key"), value.alias("value"))
    return topics.decode(records).select("offset", "ticker", "timestamp", "period", "interval", *PRICES, "volume")


@query("parse_timestamp", using("messages", """SELECT "offset", event_ts AS ts, CAST(NULL AS TIMESTAMP) AS junk FROM messages"""))
def parse_timestamp(spark, sf):
    return messages(spark, sf).select(
        "offset", X.parse_timestamp(F.col("timestamp")).cast(NTZ).alias("ts"),
        X.parse_timestamp(F.concat(F.lit("x"), "timestamp")).cast(NTZ).alias("junk"))


@query("epoch_millis", using("messages", """SELECT "offset", epoch_us(event_ts) // 1000 AS full_ms,
    epoch_ms(date_trunc('day', event_ts)) AS date_ms, epoch_ms(date_trunc('second', event_ts)) AS spaced_ms FROM messages"""))
def epoch_millis(spark, sf):
    text = F.col("timestamp")
    return messages(spark, sf).select(
        "offset", X.epoch_millis(text).alias("full_ms"), X.epoch_millis(F.substring(text, 1, 10)).alias("date_ms"),
        X.epoch_millis(F.concat(F.substring(text, 1, 10), F.lit(" "), F.substring(text, 12, 8), F.lit("+00:00"))).alias("spaced_ms"))


@query("ticker_filter", using("ticks", "SELECT seq, ticker, price FROM ticks WHERE upper(trim(ticker)) = 'CLICK'"))
def ticker_filter(spark, sf):
    return ticks(spark, sf).where(X.same_ticker(F.col("ticker"), F.lit(" click "))).select("seq", "ticker", "price")


# Zero values turn into infinities here, missing steps into NULLs.
NOISY = """SELECT event_id AS seq, event_type AS ticker, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 11 = 0
    THEN CAST('inf' AS DOUBLE) ELSE value END AS close, CASE WHEN user_id % 13 = 0 THEN CAST('-inf' AS DOUBLE) ELSE value END AS open
    FROM events"""


def noisy(spark, sf):
    inf = float("inf")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("ticker"),
        F.when(F.col("user_id") % 7 == 0, None).when(F.col("user_id") % 11 == 0, inf).otherwise(F.col("value")).alias("close"),
        F.when(F.col("user_id") % 13 == 0, -inf).otherwise(F.col("value")).alias("open"))


@query("finite_filter", f"WITH noisy AS ({NOISY}) SELECT seq, ticker, close FROM noisy WHERE close IS NOT NULL AND isfinite(close)")
def finite_filter(spark, sf):
    return C.finite_rows(noisy(spark, sf)).select("seq", "ticker", "close")


@query("inf_to_null", f"""WITH noisy AS ({NOISY}) SELECT seq, ticker, CASE WHEN isfinite(close) THEN close END AS close,
    CASE WHEN isfinite(open) THEN open END AS open FROM noisy""")
def inf_to_null(spark, sf):
    return C.infinities_to_null(noisy(spark, sf))


@query("inf_null_audit", f"""WITH noisy AS ({NOISY}) SELECT 'close' AS field, count(*) FILTER (isinf(close)) AS inf,
    count(*) FILTER (close IS NULL) AS missing FROM noisy UNION ALL SELECT 'open', count(*) FILTER (isinf(open)),
    count(*) FILTER (open IS NULL) FROM noisy""")
def inf_null_audit(spark, sf):
    return quality.inf_null_audit(noisy(spark, sf))


@query("feature_projection", using("logs", f"""SELECT ticker, date, {r('close_log')} AS close_log, open, 0.0::DOUBLE AS missing_feature,
    CAST(volume AS DOUBLE) AS volume FROM logs"""))
def feature_projection(spark, sf):
    rows = features.with_log_prices(bars(spark, sf))
    return rounded(C.project_features(rows, ["close_log", "open", "missing_feature", "volume"]), ["close_log"])


@query("numeric_coerce", """SELECT event_id, coalesce(TRY_CAST(CASE WHEN user_id % 3 = 0 THEN event_type
    ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0.0) AS number FROM events""")
def numeric_coerce(spark, sf):
    text = F.when(F.col("user_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", X.numeric_or_zero(text).alias("number"))


@query("drop_incomplete", using("ret", f"""SELECT ticker, date, {r('close_log_return')} AS close_log_return FROM ret
    WHERE close_log_return IS NOT NULL"""))
def drop_incomplete(spark, sf):
    rows = R.tiled(features.positioned(bars(spark, sf)), ["ticker"],
                   lambda t, w: features.with_log_returns(t, w, ["close"]), lookback=1)
    return rounded(C.drop_incomplete(rows, ["close_log_return"]).select("ticker", "date", "close_log_return"), ["close_log_return"])


@query("valid_points", using("panel", """SELECT ticker, date, date AS point_date, open, high, low, close, volume FROM panel
    WHERE coalesce(open, high, low, close) IS NOT NULL"""))
def valid_points(spark, sf):
    from tapework.operators import clean
    points = C.valid_points(clean.align(bars(spark, sf)))
    back = F.from_json("point", "date date, open double, high double, low double, close double, volume bigint")
    return points.select("ticker", "date", back.alias("p")).select(
        "ticker", "date", F.col("p.date").alias("point_date"), *[f"p.{c}" for c in (*PRICES, "volume")])


@query("drop_volume", using("bars", "SELECT ticker, date, open, high, low, close FROM bars"))
def drop_volume(spark, sf):
    return C.drop_volume(bars(spark, sf))


@query("direction_label", using("preds", f"""SELECT ticker, fold, date, {r('pred')} AS predicted_log_return,
    CASE WHEN pred > 0.0001 THEN 'UP' WHEN pred < -0.0001 THEN 'DOWN' ELSE 'SIDEWAYS' END AS direction FROM preds"""))
def direction_label(spark, sf):
    out = model.ols1_forecast(xy(spark, sf))
    return out.select("ticker", "fold", "date", rnd("pred").alias("predicted_log_return"),
                      X.direction_label(F.col("pred")).alias("direction"))


@query("confidence_split", using("preds", f"""SELECT ticker, fold, date, {r('c', 2)} AS confidence,
    {r('CASE WHEN pred > 0.0001 THEN c ELSE 100 - c END', 2)} AS long_share,
    {r('CASE WHEN pred > 0.0001 THEN 100 - c ELSE c END', 2)} AS short_share
    FROM (SELECT *, greatest(10.0, least(95.0, abs(pred) * 10000)) AS c FROM preds)"""))
def confidence_split(spark, sf):
    out = model.ols1_forecast(xy(spark, sf)).withColumn("c", X.confidence(F.col("pred")))
    up = X.direction_label(F.col("pred")) == "UP"
    return out.select("ticker", "fold", "date", rnd("c", 2).alias("confidence"),
                      rnd(F.when(up, F.col("c")).otherwise(100 - F.col("c")), 2).alias("long_share"),
                      rnd(F.when(up, 100 - F.col("c")).otherwise(F.col("c")), 2).alias("short_share"))


@query("forecast_point", using("preds ticks", f"""SELECT t.ticker, last_price, {r('last_price * exp(predicted_log_return)')} AS predicted_price,
    forecast_ms FROM (SELECT ticker, arg_max(price, ts) AS last_price, CAST(floor((max(epoch_us(ts)) +
    coalesce(nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / nullif(count(*) - 1, 0), 0), 60000000)) / 1000) AS BIGINT) AS forecast_ms
    FROM ticks GROUP BY 1) t JOIN p ON p.ticker = t.ticker""",
    p="""SELECT CASE ticker WHEN '1-URGENT' THEN 'click' WHEN '2-HIGH' THEN 'error' WHEN '3-MEDIUM' THEN 'purchase'
    WHEN '4-NOT SPECIFIED' THEN 'signup' ELSE 'view' END AS ticker, arg_max(pred, date) AS predicted_log_return FROM preds GROUP BY 1"""))
def forecast_point(spark, sf):
    same = {"1-URGENT": "click", "2-HIGH": "error", "3-MEDIUM": "purchase", "4-NOT SPECIFIED": "signup", "5-LOW": "view"}
    last = model.ols1_forecast(xy(spark, sf)).groupBy("ticker").agg(F.max_by("pred", "date").alias("predicted_log_return"))
    predictions = last.select(X.lookup(F.col("ticker"), same).alias("ticker"), "predicted_log_return")
    return rounded(joins.forecast_point(ticks(spark, sf), predictions), ["predicted_price"])


NATIONS = """SELECT 'NATION_' || (o_orderkey % 30) AS code, o_orderkey, o_totalprice FROM orders"""


@query("display_name", f"""SELECT o.o_orderkey, o.code, coalesce('Nation no. ' || n.n_nationkey, o.code) AS name
    FROM ({NATIONS}) o LEFT JOIN nation n ON n.n_name = o.code""")
def display_name(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("NATION_"), (F.col("o_orderkey") % 30).cast("string")).alias("code"))
    # The mapping is a literal of the operator; this table has one row per nation.
    names = {n.n_name: f"Nation no. {n.n_nationkey}" for n in table(spark, sf, "nation").collect()}
    return rows.select("o_orderkey", "code", X.display_name(F.col("code"), names).alias("name"))


@query("ticker_search", """SELECT c_custkey, c_name, c_mktsegment FROM customer
    WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')""")
def ticker_search(spark, sf):
    return table(spark, sf, "customer").where(
        X.ticker_matches("BUILD", F.col("c_name"), F.col("c_mktsegment"))).select("c_custkey", "c_name", "c_mktsegment")


SELECTED = [f"{p}{s}" for p in PRICES for s in ("", "_log", "_log_return")]


@query("selected_features", using("ret", f"SELECT ticker, date, {rsql(SELECTED)} FROM ret"))
def selected_features(spark, sf):
    rows = R.tiled(features.positioned(bars(spark, sf)), ["ticker"], features.with_log_returns, lookback=1)
    return rounded(C.selected_features(rows), SELECTED)


@query("interval_compat", using("messages", """SELECT m."offset", c.chart, c.key, c.ok FROM messages m JOIN (VALUES
    ('5m', '1d_1m', true), ('1h', '1d_1m', false), ('1d', '5d_1wk', false), ('1mo', 'max_1mo', true), ('1h', '1d_tick', true),
    ('1d', 'plain', true)) c(chart, key, ok) ON c.chart = (CASE m."offset" % 6 WHEN 0 THEN '5m' WHEN 1 THEN '1h' WHEN 2 THEN '1d'
    WHEN 3 THEN '1mo' WHEN 4 THEN '1h' ELSE '1d' END) AND c.key = (CASE m."offset" % 6 WHEN 0 THEN '1d_1m' WHEN 1 THEN '1d_1m'
    WHEN 2 THEN '5d_1wk' WHEN 3 THEN 'max_1mo' WHEN 4 THEN '1d_tick' ELSE 'plain' END)"""))
def interval_compat(spark, sf):
    case = (F.col("offset") % 6 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), case)
    rows = messages(spark, sf).select("offset", pick("5m", "1h", "1d", "1mo", "1h", "1d").alias("chart"),
                                      pick("1d_1m", "1d_1m", "5d_1wk", "max_1mo", "1d_tick", "plain").alias("key"))
    return rows.withColumn("ok", X.intervals_compatible(F.col("chart"), X.partition_interval(F.col("key"))))


ASKED = "['1d', '5d', '1mo', '3mo', '6mo', '1y', '2y', '5y', 'max', '10y']"


@query("period_config", f"""SELECT event_id, period, CASE period WHEN '1mo' THEN '2mo' ELSE period END AS fetch_period,
    coalesce(asked, CASE period WHEN '1d' THEN '5m' WHEN '5d' THEN '5m' WHEN '5y' THEN '1wk' WHEN 'max' THEN '1mo' ELSE '1d' END)
    AS fetch_interval FROM (SELECT event_id, ({ASKED})[event_id % 10 + 1] AS period,
    CASE WHEN user_id % 4 = 0 THEN '15m' END AS asked FROM events)""")
def period_config(spark, sf):
    periods = ("1d", "5d", "1mo", "3mo", "6mo", "1y", "2y", "5y", "max", "10y")
    rows = table(spark, sf, "events").select(
        "event_id", F.element_at(F.array(*[F.lit(p) for p in periods]), (F.col("event_id") % 10 + 1).cast("int")).alias("period"),
        F.when(F.col("user_id") % 4 == 0, "15m").alias("asked"))
    return rows.select("event_id", "period", X.fetch_period(F.col("period")).alias("fetch_period"),
                       X.fetch_interval(F.col("period"), F.col("asked")).alias("fetch_interval"))
