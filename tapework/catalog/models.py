"""Queries: scaling, forecasts, searches, scoring and run records."""

from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.catalog.backtests import FOLD_COLUMNS, LOSS, MAPE, R2, preds, xy
from tapework.catalog.base import PRICES, query, r, rnd, rounded, rsql, using
from tapework.functions import scalar as X
from tapework.operators import backtest, clean, features, joins, model, ranking, refits, splits, trees
from tapework.operators import series as R
from tapework.session import materialize, scratch
from tapework.sources.fixtures import bars

KEYS = ["ticker", "fold"]
NAMES = S.training_features()


def training(spark, sf):
    return materialize(features.training_frame(bars(spark, sf)), "training")


SEGMENTED = """SELECT b.*, fold, pos < n - (4 - fold) * (n // 5) AS train,
    pos >= n - (4 - fold) * (n // 5) AND pos < n - (3 - fold) * (n // 5) AS test FROM (SELECT *,
    row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n FROM bars) b CROSS JOIN folds"""
SCALED = "SELECT ticker, fold, " + ", ".join(
    f"avg({c}) AS {c}_mean, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS {c}_std" for c in PRICES) + " FROM seg WHERE train GROUP BY 1, 2"


@query("standardize", using("bars folds", "SELECT s.ticker, s.fold, date, " + ", ".join(
    f"{r(f'({c} - {c}_mean) / {c}_std')} AS {c}" for c in PRICES)
    + " FROM seg s JOIN m ON m.ticker = s.ticker AND m.fold = s.fold WHERE test", seg=SEGMENTED, m=SCALED))
def standardize(spark, sf):
    return rounded(model.standardize(bars(spark, sf).select("ticker", "date", *PRICES), PRICES), PRICES)


@query("target_scale", using("xy folds", f"""SELECT s.ticker, s.fold, date, {r('(y - m) / d')} AS y, {r('y')} AS y_original FROM parts s
    JOIN t ON t.ticker = s.ticker AND t.fold = s.fold WHERE pos >= test_start AND pos < test_start + size""",
    parts="SELECT xy.*, fold, n - (4 - fold) * (n // 5) AS test_start, n // 5 AS size FROM xy CROSS JOIN folds",
    t="SELECT ticker, fold, avg(y) AS m, coalesce(nullif(stddev_pop(y), 0), 1.0) AS d FROM parts WHERE pos < test_start GROUP BY 1, 2"))
def target_scale(spark, sf):
    frame = xy(spark, sf)
    scaled = model.standardize(frame, ["y"])
    stats = model.train_stats(splits.with_segments(frame), ["y"])
    return rounded(model.invert_scale(scaled, stats, "y"), ["y", "y_original"])


WALK = """SELECT p.ticker, p.fold, p.date, l.slope * p.x + l.intercept AS pred, p.y AS actual FROM
    (SELECT *, (pos - 200) // 25 AS fold FROM xy WHERE pos >= 200) p JOIN (SELECT ticker, f AS fold, regr_slope(y, x) AS slope,
    regr_intercept(y, x) AS intercept FROM xy JOIN range(0, 100000) t(f) ON pos < 200 + 25 * f AND 225 + 25 * f <= n GROUP BY 1, 2) l
    ON l.ticker = p.ticker AND l.fold = p.fold"""


@query("walk_forward_forecast", using("xy", f"SELECT ticker, fold, date, {r('pred')} AS pred, {r('actual')} AS actual FROM w", w=WALK))
def walk_forward_forecast(spark, sf):
    out = model.walk_forward_forecast(xy(spark, sf)).select(*KEYS, "date", "pred", "actual")
    return rounded(out, ["pred", "actual"])


@query("ridge_forecast")
def ridge_forecast(spark, sf):
    return model.ridge_forecast(training(spark, sf), NAMES).select(*KEYS, "date", "pred", "actual")


@query("param_sweep")
def param_sweep(spark, sf):
    strengths = [10.0 ** (k / 2) for k in range(-5, 10)]
    return model.param_sweep(training(spark, sf), NAMES, strengths)


@query("gbt_forecast")
def gbt_forecast(spark, sf):
    return trees.gbt_forecast(training(spark, sf), NAMES)


@query("gbt_search")
def gbt_search(spark, sf):
    """Fifteen trials a fold from one binned table; the worse half goes after each doubling of the rounds."""
    return trees.gbt_search(training(spark, sf), NAMES, trees.space(15))


# Ridge of y on two returns in closed form: standardised features, so the system is [[n+s, n r], [n r, n+s]].
def two_sql(first, second):
    """``two``: rows with two inputs, their target and their place."""
    return f"""SELECT ticker, date, x1, x2, y, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,
    count(*) OVER (PARTITION BY ticker) AS n FROM (SELECT ticker, date, {first} AS x1, {second} AS x2, lead(close_log_return) OVER w AS y
    FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL"""


TWO_FITS = dict(
    cut="SELECT two.*, fold, n - (4 - fold) * (n // 5) AS test_start, n // 5 AS size FROM two CROSS JOIN (SELECT unnest([0, 1, 2, 3])::BIGINT AS fold)",
    m="""SELECT ticker, fold, count(*) AS k, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS d1, stddev_pop(x2) AS d2,
    corr(x1, x2) AS rho, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM cut WHERE pos < test_start GROUP BY 1, 2""",
    s="SELECT i AS trial, power(10.0, (i - 5) / 2.0) AS strength FROM range(15) t(i)",
    w="""SELECT ticker, fold, trial, strength, m1, m2, my, d1, d2,
    ((k + strength) * k * c1 / d1 - k * rho * k * c2 / d2) / ((k + strength) * (k + strength) - k * rho * k * rho) AS w1,
    ((k + strength) * k * c2 / d2 - k * rho * k * c1 / d1) / ((k + strength) * (k + strength) - k * rho * k * rho) AS w2 FROM m CROSS JOIN s""",
    p="""SELECT c.ticker, c.fold, c.date, trial, strength, my + w1 * (x1 - m1) / d1 + w2 * (x2 - m2) / d2 AS pred, y AS actual FROM cut c
    JOIN w ON w.ticker = c.ticker AND w.fold = c.fold WHERE pos >= test_start AND pos < test_start + size""")
TWO = using("ret", "", two=two_sql("lag(close_log_return) OVER w", "lag(open_log_return) OVER w"), **TWO_FITS)
TWO_WINDOW = using("ret", "", two=two_sql("lag(close_log_return) OVER w", "close_log_return"), **TWO_FITS)
# The same fits before every step of 25 rows, on all rows before it.
TWO_WALK = using("ret", "", two=two_sql("lag(close_log_return) OVER w", "lag(open_log_return) OVER w"), **TWO_FITS | {
    "cut": """SELECT two.*, f AS fold, 200 + 25 * f AS test_start, 25 AS size FROM two JOIN range(0, 100000) t(f)
    ON pos < 225 + 25 * f AND 225 + 25 * f <= n"""})


def two_features(spark, sf):
    rows = R.tiled(features.positioned(bars(spark, sf)), ["ticker"], lambda t, w: features.with_log_returns(t, w).select(
        "*", F.lag("close_log_return").over(w).alias("x1"), F.lag("open_log_return").over(w).alias("x2"),
        F.lead("close_log_return").over(w).alias("target")), lookback=2, lookahead=1)
    return materialize(rows.select("ticker", "date", "x1", "x2", "target").na.drop(), "two")


# Of the fifteen strengths, trial 5 is 1 and trial 9 is 100.
@query("walk_forward_two", TWO_WALK + f"SELECT ticker, fold, date, {r('pred')} AS pred, {r('actual')} AS actual FROM p WHERE trial = 5")
def walk_forward_two(spark, sf):
    return rounded(refits.walk_forward_ridge(two_features(spark, sf), ["x1", "x2"]), ["pred", "actual"])


@query("walk_forward_ridge")
def walk_forward_ridge(spark, sf):
    """The 18 technical columns, refitted every 25 rows."""
    return refits.walk_forward_ridge(materialize(features.technical_frame(bars(spark, sf)), "technical"), S.TECHNICAL_FEATURES)


@query("ridge_two", TWO + f"SELECT ticker, fold, date, {r('pred')} AS pred, {r('actual')} AS actual FROM p WHERE trial = 9")
def ridge_two(spark, sf):
    out = model.ridge_forecast(two_features(spark, sf), ["x1", "x2"], strength=100.0)
    return rounded(out.select(*KEYS, "date", "pred", "actual"), ["pred", "actual"])


@query("sweep_two", TWO + f"""SELECT ticker, fold, CAST(trial AS INTEGER) AS trial, {r('avg(abs(actual - pred))')} AS mae,
    {r('sqrt(avg((actual - pred) * (actual - pred)))')} AS rmse FROM p GROUP BY 1, 2, 3""")
def sweep_two(spark, sf):
    strengths = [10.0 ** (k / 2) for k in range(-5, 10)]
    out = model.param_sweep(two_features(spark, sf), ["x1", "x2"], strengths)
    return rounded(out.select(*KEYS, "trial", "mae", "rmse"), ["mae", "rmse"])


@query("score_two", TWO + f"""SELECT ticker, fold, date, {r('pred')} AS pred, CASE WHEN pred > 0.0001 THEN 'UP' WHEN pred < -0.0001 THEN 'DOWN'
    ELSE 'SIDEWAYS' END AS direction FROM p WHERE trial = 5 AND fold = 3""")
def score_two(spark, sf):
    """Models of several features through the registry table and back, joined to the rows they score."""
    rows = materialize(splits.with_segments(two_features(spark, sf)), "segments")
    made = materialize(model.ridge_models(rows, ["x1", "x2"], strengths=[1.0]).where("fold = 3"), "models")
    test = splits.test_rows(rows).where("fold = 3")
    out = joins.score_join(test, made, ["x1", "x2"], KEYS)
    return out.select(*KEYS, "date", rnd("pred").alias("pred"), X.direction_label(F.col("pred")).alias("direction"))


FACTORS = (0.25, 0.5, 0.75, 1.0)
TRIALS = f"""SELECT ticker, fold, trial, factor, {LOSS} AS loss FROM (SELECT ticker, fold, trial, factor,
    avg(abs(actual - pred)) AS mae, {MAPE} AS mape, {R2} AS r2, avg(abs(actual)) AS mean_abs FROM
    (SELECT ticker, fold, actual, trial, factor, pred * factor AS pred FROM preds CROSS JOIN
    (VALUES (0, 0.25), (1, 0.5), (2, 0.75), (3, 1.0)) t(trial, factor)) GROUP BY 1, 2, 3, 4)"""
BEST_TRIAL = "SELECT ticker, fold, CAST(arg_min(trial, loss) AS INTEGER) AS trial, min(loss) AS loss FROM tr GROUP BY 1, 2"


def trials(spark, sf):
    return model.shrinkage_trials(preds(spark, sf), FACTORS)


@query("best_trial", using("preds", f"SELECT ticker, fold, trial, {r('loss', 4)} AS loss FROM b", tr=TRIALS, b=BEST_TRIAL))
def best_trial(spark, sf):
    return rounded(ranking.best_trial(trials(spark, sf)), ["loss"], 4)


@query("config_fallback", using("preds", """SELECT f.ticker, f.fold, coalesce(b.trial, 3) AS trial, coalesce(b.window_size, 30) AS window_size,
    b.ticker IS NOT NULL AS tuned FROM (SELECT DISTINCT ticker, fold FROM preds) f LEFT JOIN (SELECT *, CAST(20 + trial * 5 AS INTEGER) AS window_size
    FROM b WHERE ticker IN ('1-URGENT', '5-LOW')) b ON b.ticker = f.ticker AND b.fold = f.fold""", tr=TRIALS, b=BEST_TRIAL))
def config_fallback(spark, sf):
    """Only two tickers are searched, as only poor instruments are; the rest keep the defaults."""
    made = preds(spark, sf)
    tuned = ranking.best_trial(model.shrinkage_trials(made.where("ticker in ('1-URGENT', '5-LOW')"), FACTORS)).select(
        *KEYS, "trial", (F.col("trial") * 5 + 20).alias("window_size"))
    return model.config_or_default(made.select(*KEYS).distinct(), tuned,
                                   {"trial": 3, "window_size": S.DEFAULT_WINDOW})



def line_models(spark, sf):
    """A one-feature model row per ticker, as the registry would hold it: the last fold's line."""
    rows = splits.with_segments(xy(spark, sf))
    train = rows.where("segment < 4").groupBy("ticker").agg(
        F.array(F.avg("x")).alias("mean"), F.array(F.stddev_pop("x")).alias("scale"),
        F.array(F.regr_slope("y", "x") * F.stddev_pop("x")).alias("weights"), F.avg("y").alias("intercept"))
    return train


SCORED = """SELECT x.ticker, date, l.slope * x + l.intercept AS pred FROM xy x JOIN (SELECT ticker, regr_slope(y, x) AS slope,
    regr_intercept(y, x) AS intercept FROM xy WHERE pos < n - n // 5 GROUP BY 1) l ON l.ticker = x.ticker"""


@query("score_join", using("xy", f"SELECT ticker, date, {r('pred')} AS pred FROM s", s=SCORED))
def score_join(spark, sf):
    rows = xy(spark, sf).select("ticker", "date", "x")
    return rounded(joins.score_join(rows, line_models(spark, sf), ["x"]).select("ticker", "date", "pred"), ["pred"])


@query("batch_score", using("xy", f"""SELECT ticker, date, {r('pred')} AS predicted_log_return, CASE WHEN pred > 0.0001 THEN 'UP'
    WHEN pred < -0.0001 THEN 'DOWN' ELSE 'SIDEWAYS' END AS direction FROM s QUALIFY date = max(date) OVER (PARTITION BY ticker)""", s=SCORED))
def batch_score(spark, sf):
    """Latest row of every ticker, scored and labelled."""
    last = clean.latest(xy(spark, sf).select("ticker", "date", "x"), ["ticker"], "date")
    out = joins.score_join(last, line_models(spark, sf), ["x"])
    return out.select("ticker", "date", rnd("pred").alias("predicted_log_return"),
                      X.direction_label(F.col("pred")).alias("direction"))


def returns(spark, sf):
    rows = R.tiled(features.positioned(bars(spark, sf)), ["ticker"], features.with_log_returns, lookback=1)
    return materialize(features.plain(rows.where("close_log_return is not null")), "returns")


@query("sequence_score")
def sequence_score(spark, sf):
    """Thirty rows of four returns, 120 inputs, scored by a ridge model per fold."""
    return refits.sequence_ridge(returns(spark, sf), [f"{p}_log_return" for p in PRICES], "close_log_return", 30)


# Windows of two returns of one column: the same two-column ridge.
@query("sequence_two", TWO_WINDOW + f"SELECT ticker, fold, date, {r('pred')} AS pred, {r('actual')} AS actual FROM p WHERE trial = 5")
def sequence_two(spark, sf):
    out = refits.sequence_ridge(returns(spark, sf), ["close_log_return"], "close_log_return", 2)
    return rounded(out, ["pred", "actual"])


@query("run_log", using("report_flat", " UNION ALL ".join(
    f"SELECT 'run' AS run_id, ticker, fold, '{c}' AS key, {r(c)} AS value FROM report_flat" for c in FOLD_COLUMNS)))
def run_log(spark, sf):
    log = model.run_log(backtest.report(preds(spark, sf)), "run")
    path = scratch(spark, "runs")
    log.write.mode("append").partitionBy("run_id").parquet(path)
    return rounded(spark.read.schema(log.schema).parquet(path), ["value"]).select("run_id", *KEYS, "key", "value")


@query("run_log_wide", using("report_flat", f"SELECT 'run' AS run_id, ticker, fold, {rsql(FOLD_COLUMNS)} FROM report_flat"))
def run_log_wide(spark, sf):
    log = materialize(model.run_log(backtest.report(preds(spark, sf)), "run"), "runs")
    return rounded(model.read_run_log(log, FOLD_COLUMNS), FOLD_COLUMNS)


# Walk-forward predictions under the turnover convention, summed up per ticker.
WALK_NETS = """SELECT *, position * actual - abs(position - previous) * 0.0001 AS net FROM (SELECT *,
    lag(position, 1, 0.0) OVER (PARTITION BY ticker, fold ORDER BY date) AS previous FROM (SELECT *,
    CASE WHEN abs(pred) < 1e-5 THEN 0.0 ELSE CAST(sign(pred) AS DOUBLE) END AS position FROM w))"""
WALK_DD = """SELECT ticker, fold, max(top - cum) AS max_dd FROM (SELECT *, max(cum) OVER (PARTITION BY ticker, fold ORDER BY date
    ROWS UNBOUNDED PRECEDING) AS top FROM (SELECT *, sum(net) OVER (PARTITION BY ticker, fold ORDER BY date ROWS UNBOUNDED PRECEDING)
    AS cum FROM nets)) GROUP BY 1, 2"""
WALK_FOLDS = """SELECT n.ticker, n.fold, avg(net) / nullif(stddev_pop(net), 0) * sqrt(252) AS sharpe, max(max_dd) AS max_dd,
    avg(CASE WHEN sign(pred) = sign(actual) THEN 1.0 ELSE 0.0 END) AS hit_rate,
    CASE WHEN stddev_pop(pred) > 0 AND stddev_pop(actual) > 0 THEN corr(pred, actual) END AS ic, sum(net) AS net_pnl
    FROM nets n JOIN dd ON dd.ticker = n.ticker AND dd.fold = n.fold GROUP BY 1, 2"""


@query("walk_forward_report", using("xy", "SELECT ticker, " + ", ".join(
    f"{r(f'{a}({c})')} AS {c}" for c, a in (("sharpe", "avg"), ("max_dd", "max"), ("hit_rate", "avg"), ("ic", "avg"), ("net_pnl", "sum")))
    + " FROM f GROUP BY 1", w=WALK, nets=WALK_NETS, dd=WALK_DD, f=WALK_FOLDS))
def walk_forward_report(spark, sf):
    from tapework.plans import forecast
    out = ranking.ticker_summary(forecast.fold_report(bars(spark, sf), "turnover"))
    return rounded(out, ["sharpe", "max_dd", "hit_rate", "ic", "net_pnl"])
