"""Queries: window features."""

from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.catalog.base import PRICES, query, r, rnd, rounded, rsql, using
from tapework.operators import clean, features as X, series as R
from tapework.sources.fixtures import bars

W = "(PARTITION BY ticker ORDER BY date)"


def on_bars(spark, sf, build, lookback, lookahead=0):
    return R.tiled(X.positioned(bars(spark, sf)), ["ticker"], build, lookback, lookahead)


def frame(k, shift=0):
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {k - 1 + shift} PRECEDING AND {shift or 'CURRENT'} {'PRECEDING' if shift else 'ROW'})"


def full(agg, col, k, shift=0):
    return f"CASE WHEN count({col}) OVER {frame(k, shift)} = {k} THEN {agg}({col}) OVER {frame(k, shift)} END"


LOGS = [f"{p}_log" for p in PRICES]
RETURNS = [f"{p}_log_return" for p in PRICES]


@query("log_price", using("logs", f"SELECT ticker, date, {rsql(LOGS)} FROM logs"))
def log_price(spark, sf):
    return rounded(X.with_log_prices(bars(spark, sf)).select("ticker", "date", *LOGS), LOGS)


DIFFS = [f"{p}_diff" for p in PRICES]


@query("diff", using("bars", "SELECT ticker, date, " + ", ".join(
    f"{r(f'{p} - lag({p}) OVER {W}', 4)} AS {p}_diff" for p in PRICES) + " FROM bars"))
def diff(spark, sf):
    rows = on_bars(spark, sf, X.with_diffs, 1)
    return rounded(rows.select("ticker", "date", *DIFFS), DIFFS, 4)


@query("log_return", using("ret", f"SELECT ticker, date, {rsql(RETURNS)} FROM ret"))
def log_return(spark, sf):
    return rounded(on_bars(spark, sf, X.with_log_returns, 1).select("ticker", "date", *RETURNS), RETURNS)


@query("momentum", using("bars", f"SELECT ticker, date, {r(f'close - lag(close, 5) OVER {W}', 4)} AS close_momentum_5 FROM bars"))
def momentum(spark, sf):
    rows = on_bars(spark, sf, lambda t, w: t.withColumn("close_momentum_5", F.col("close") - F.lag("close", 5).over(w)), 5)
    return rounded(rows.select("ticker", "date", "close_momentum_5"), ["close_momentum_5"], 4)


@query("sma", using("bars", "SELECT ticker, date, " + ", ".join(
    f"{r(full('avg', 'close', k), 5)} AS close_ma_{k}" for k in S.MA_WINDOWS) + " FROM bars"))
def sma(spark, sf):
    names = [f"close_ma_{k}" for k in S.MA_WINDOWS]
    rows = on_bars(spark, sf, lambda t, w: t.withColumns(
        {f"close_ma_{k}": X.rolling_mean("close", k, w) for k in S.MA_WINDOWS}), max(S.MA_WINDOWS))
    return rounded(rows.select("ticker", "date", *names), names, 5)


EMA_SQL = "WITH RECURSIVE " + using("ret", "", ema="""SELECT ticker, pos, date, close, close AS e5, close AS e12, close AS e26
    FROM ret WHERE pos = 0 UNION ALL SELECT n.ticker, n.pos, n.date, n.close,
    (2.0/6)::DOUBLE * n.close + (1 - (2.0/6)::DOUBLE) * e.e5, (2.0/13)::DOUBLE * n.close + (1 - (2.0/13)::DOUBLE) * e.e12,
    (2.0/27)::DOUBLE * n.close + (1 - (2.0/27)::DOUBLE) * e.e26
    FROM ema e JOIN ret n ON n.ticker = e.ticker AND n.pos = e.pos + 1""").removeprefix("WITH ") + (
    f"SELECT ticker, date, {r('e5', 3)} AS close_ema_5, {r('e12', 3)} AS close_ema_12, {r('e26', 3)} AS close_ema_26 FROM ema")


# The recursion as it is: a NULL keeps the mean and lets its weight decay.
EMA_TESTED = (1, 2, 5, 12, 26, 50, 200)


def _ema_step(s):
    q = f"(1 - (2.0::DOUBLE / {s + 1}))"
    return f"""CASE WHEN n.x IS NULL THEN e.y{s} WHEN e.y{s} IS NULL THEN n.x
        ELSE (e.w{s} * {q} * e.y{s} + (2.0::DOUBLE / {s + 1}) * n.x) / (e.w{s} * {q} + (2.0::DOUBLE / {s + 1})) END AS y{s},
        CASE WHEN n.x IS NULL THEN e.w{s} * {q} ELSE 1.0::DOUBLE END AS w{s}"""


NULL_EMA_SQL = "WITH RECURSIVE " + using(
    "bars", "", gaps="""SELECT ticker, date, CASE WHEN day(date) IN (3, 4, 17) THEN NULL ELSE close END AS x,
    row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos FROM bars""",
    ema="SELECT ticker, pos, date, " + ", ".join(f"x AS y{s}, 1.0::DOUBLE AS w{s}" for s in EMA_TESTED) + " FROM gaps WHERE pos = 0 UNION ALL "
    "SELECT n.ticker, n.pos, n.date, " + ", ".join(_ema_step(s) for s in EMA_TESTED)
    + " FROM ema e JOIN gaps n ON n.ticker = e.ticker AND n.pos = e.pos + 1").removeprefix("WITH ") + (
    "SELECT ticker, date, " + ", ".join(f"{r(f'y{s}', 3)} AS close_ema_{s}" for s in EMA_TESTED) + " FROM ema")


@query("ema", NULL_EMA_SQL)
def ema(spark, sf):
    names = [f"close_ema_{s}" for s in EMA_TESTED]
    gaps = bars(spark, sf).select("ticker", "date", F.when(~F.dayofmonth("date").isin(3, 4, 17), F.col("close")).alias("close"))
    rows = X.with_emas(X.positioned(gaps), spans=EMA_TESTED)
    return rounded(rows.select("ticker", "date", *names), names, 3)


VOLS = [f"close_log_return_vol_{k}" for k in S.VOL_WINDOWS]


@query("rolling_vol", using("ret", "SELECT ticker, date, " + ", ".join(
    f"{r(full('stddev_samp', 'close_log_return', k))} AS close_log_return_vol_{k}" for k in S.VOL_WINDOWS) + " FROM ret"))
def rolling_vol(spark, sf):
    def build(t, w):
        t = X.with_log_returns(t, w, ["close"])
        return t.withColumns({f"close_log_return_vol_{k}": X.rolling_std("close_log_return", k, w) for k in S.VOL_WINDOWS})
    return rounded(on_bars(spark, sf, build, max(S.VOL_WINDOWS) + 1).select("ticker", "date", *VOLS), VOLS)


@query("range_features", using("bars", f"""SELECT ticker, date, {r('high - low', 4)} AS high_low_range,
    {r('(high - low) / nullif(low, 0)')} AS high_low_range_pct FROM bars"""))
def range_features(spark, sf):
    rows = bars(spark, sf).withColumns(X.range_features())
    return rows.select("ticker", "date", rnd("high_low_range", 4).alias("high_low_range"),
                       rnd("high_low_range_pct").alias("high_low_range_pct"))


@query("direction_sign", using("ret", """SELECT ticker, date,
    CAST(sign(coalesce(close_log_return, 0)) AS DOUBLE) AS close_direction FROM ret"""))
def direction_sign(spark, sf):
    rows = on_bars(spark, sf, lambda t, w: X.with_log_returns(t, w, ["close"]), 1)
    return rows.select("ticker", "date", X.direction_sign("close_log_return").alias("close_direction"))


LAG_NAMES = [f"close_log_return_lag_{k}" for k in S.LAGS]
LAG_SQL = ", ".join(f"lag(close_log_return, {k}) OVER {W} AS close_log_return_lag_{k}" for k in S.LAGS)


@query("lag_features", using("ret", f"SELECT ticker, date, {rsql(LAG_NAMES)} FROM lagged",
                             lagged=f"SELECT ticker, date, {LAG_SQL} FROM ret"))
def lag_features(spark, sf):
    rows = on_bars(spark, sf, lambda t, w: X.with_lags(X.with_log_returns(t, w, ["close"]), w), 201)
    return rounded(rows.select("ticker", "date", *LAG_NAMES), LAG_NAMES)


MEANS = [f"close_log_return_mean_{k}" for k in S.SHIFTED_WINDOWS]
STDS = [f"close_log_return_std_{k}" for k in S.SHIFTED_WINDOWS]
MEAN_SQL = ", ".join(f"{full('avg', 'close_log_return', k, 1)} AS close_log_return_mean_{k}" for k in S.SHIFTED_WINDOWS)
STD_SQL = ", ".join(f"{full('stddev_samp', 'close_log_return', k, 1)} AS close_log_return_std_{k}" for k in S.SHIFTED_WINDOWS)


def shifted(spark, sf, names):
    rows = on_bars(spark, sf, lambda t, w: X.with_shifted_stats(X.with_log_returns(t, w, ["close"]), w), 62)
    return rounded(rows.select("ticker", "date", *names), names)


@query("shifted_mean", using("ret", f"SELECT ticker, date, {rsql(MEANS)} FROM s", s=f"SELECT ticker, date, {MEAN_SQL} FROM ret"))
def shifted_mean(spark, sf):
    return shifted(spark, sf, MEANS)


@query("shifted_std", using("ret", f"SELECT ticker, date, {rsql(STDS)} FROM s", s=f"SELECT ticker, date, {STD_SQL} FROM ret"))
def shifted_std(spark, sf):
    return shifted(spark, sf, STDS)


@query("forward_target", using("ret", f"SELECT ticker, date, {r(f'lead(close_log_return) OVER {W}')} AS target FROM ret"))
def forward_target(spark, sf):
    def build(t, w):
        return X.with_log_returns(t, w, ["close"]).withColumn("target", F.lead("close_log_return", S.HORIZON).over(w))
    return rounded(on_bars(spark, sf, build, 1, S.HORIZON).select("ticker", "date", "target"), ["target"])


NAMES = S.training_features()
FULL_SQL = f"""SELECT ticker, date, {", ".join(PRICES)}, {", ".join(LOGS)}, {", ".join(RETURNS)}, {LAG_SQL}, {MEAN_SQL},
    {STD_SQL}, lead(close_log_return) OVER {W} AS target FROM ret"""


@query("training_frame", using("ret", f"SELECT ticker, date, {rsql([*NAMES, 'target'])} FROM f WHERE "
                               + " AND ".join(f"{c} IS NOT NULL" for c in [*NAMES, "target"]), f=FULL_SQL))
def training_frame(spark, sf):
    return rounded(X.training_frame(bars(spark, sf)), [*NAMES, "target"])


@query("inference_frame_raw", using("ret", f"SELECT ticker, date, {rsql(NAMES)} FROM f", f=FULL_SQL))
def inference_frame_raw(spark, sf):
    return rounded(X.inference_frame_raw(bars(spark, sf)), NAMES)


SERVED = [*PRICES, *LOGS, *RETURNS, *LAG_NAMES, *MEANS, *STDS]
SERVING_VIEWS = {
    "ret0": "SELECT ticker, date, volume, {}, {}, {} FROM ret".format(
        ", ".join(PRICES), ", ".join(LOGS), ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in RETURNS)),
    "raw_frame": f"SELECT *, {LAG_SQL}, {MEAN_SQL}, {STD_SQL} FROM ret0",
    "served": "SELECT ticker, date, volume, " + ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), "
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS {c}"
        for c in SERVED) + " FROM raw_frame",
}


@query("inference_frame", using("ret", f"SELECT ticker, date, volume, {rsql(SERVED)} FROM served", **SERVING_VIEWS))
def inference_frame(spark, sf):
    return rounded(X.inference_frame(bars(spark, sf)).select("ticker", "date", "volume", *SERVED), SERVED)


@query("latest_features", using("ret", f"SELECT ticker, date, volume, {rsql(SERVED)} FROM served "
                                "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1", **SERVING_VIEWS))
def latest_features(spark, sf):
    served = X.inference_frame(bars(spark, sf)).select("ticker", "date", "volume", *SERVED)
    return rounded(clean.latest(served, ["ticker"], "date"), SERVED)


SEQUENCE_SQL = using("ret", f"""SELECT ticker, date, x, y FROM (SELECT ticker, date,
    list([{', '.join(r(f'{p}_log_return') for p in PRICES)}]) OVER (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING) AS x,
    list({r('close_log_return')}) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS y
    FROM ret WHERE close_log_return IS NOT NULL) WHERE len(x) = 30 AND len(y) = 3""")


def rounded_sequences(made):
    each = lambda v: F.transform(v, lambda e: F.round(e, 6))
    return made.select("ticker", "date", F.transform("x", each).alias("x"), each(F.col("y")).alias("y"))


@query("sequences", SEQUENCE_SQL)
def sequences(spark, sf):
    rows = on_bars(spark, sf, X.with_log_returns, 1).where("close_log_return is not null")
    return rounded_sequences(X.sequences(X.plain(rows), RETURNS, "close_log_return", 30, 3))


@query("sequence_sizes", using("ret", """SELECT ticker, greatest(count(*) - 30 - 3 + 1, 0) AS sequences
    FROM ret WHERE close_log_return IS NOT NULL GROUP BY 1"""))
def sequence_sizes(spark, sf):
    return sequences(spark, sf).groupBy("ticker").agg(F.count(F.lit(1)).alias("sequences"))


TECH = S.TECHNICAL_FEATURES
EMAS = [f"close_ema_{s}" for s in S.EMA_SPANS]
TECH_SQL = EMA_SQL.split("SELECT ticker, date, (CASE")[0] + (
    ", tech AS (SELECT r.ticker, r.date, r.open, r.high, r.low, r.close, close_log, close_log_return, "
    "r.close - lag(r.close, 5) OVER w AS close_momentum_5, "
    + ", ".join(f"{full('avg', 'r.close', k).replace('ticker', 'r.ticker').replace('date', 'r.date')} AS close_ma_{k}" for k in S.MA_WINDOWS)
    + ", e5 AS close_ema_5, e12 AS close_ema_12, e26 AS close_ema_26, "
    + ", ".join(f"{full('stddev_samp', 'close_log_return', k).replace('ticker', 'r.ticker').replace('date', 'r.date')} AS close_log_return_vol_{k}" for k in S.VOL_WINDOWS)
    + ", high - low AS high_low_range, (high - low) / nullif(low, 0) AS high_low_range_pct, "
    "CAST(sign(coalesce(close_log_return, 0)) AS DOUBLE) AS close_direction, lead(close_log_return) OVER w AS target "
    "FROM ret r JOIN ema e ON e.ticker = r.ticker AND e.pos = r.pos "
    "WINDOW w AS (PARTITION BY r.ticker ORDER BY r.date)) "
    f"SELECT ticker, date, {rsql([*EMAS], 3)}, {rsql([c for c in [*TECH, 'target'] if c not in EMAS], 5)} FROM tech WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in [*TECH, "target"]))


@query("technical_frame", TECH_SQL)
def technical_frame(spark, sf):
    rest = [c for c in [*TECH, "target"] if c not in EMAS]
    return rounded(rounded(X.technical_frame(bars(spark, sf)), EMAS, 3), rest, 5)


@query("feature_join", using("ret", f"""SELECT ticker, date, close, {r('close_log_return')} AS close_log_return,
    {r('high - low', 4)} AS high_low_range FROM ret"""))
def feature_join(spark, sf):
    base = bars(spark, sf)
    returns = on_bars(spark, sf, lambda t, w: X.with_log_returns(t, w, ["close"]), 1).select("ticker", "date", "close_log_return")
    ranges = base.withColumns(X.range_features()).select("ticker", "date", "close", "high_low_range")
    out = ranges.join(returns, ["ticker", "date"])
    return out.select("ticker", "date", "close", rnd("close_log_return").alias("close_log_return"),
                      rnd("high_low_range", 4).alias("high_low_range"))
