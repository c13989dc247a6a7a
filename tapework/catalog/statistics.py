"""Queries: distribution summaries, stationarity and correlation."""

from pyspark.sql import functions as F

from tapework.catalog.base import PRICES, query, r, rnd, rounded, using
from tapework.operators import clean, features, quality, stats
from tapework.operators import series as R
from tapework.sources.fixtures import bars

DESCRIBED = ["mean", "std", "min", "q25", "q50", "q75", "max"]


@query("describe", using("bars", " UNION ALL ".join(
    f"SELECT ticker, '{c}' AS field, count({c}) AS count, {r(f'avg({c})', 3)} AS mean, {r(f'stddev_samp({c})', 3)} AS std, "
    f"min({c}) AS min, {r(f'quantile_cont({c}, 0.25)', 4)} AS q25, {r(f'quantile_cont({c}, 0.5)', 4)} AS q50, "
    f"{r(f'quantile_cont({c}, 0.75)', 4)} AS q75, max({c}) AS max FROM bars GROUP BY ticker" for c in PRICES)))
def describe(spark, sf):
    out = stats.describe(bars(spark, sf))
    return rounded(rounded(out, ["mean", "std"], 3), ["q25", "q50", "q75"], 4)


@query("null_profile", using("panel", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS nulls FROM panel" for c in ("ticker", "date", *PRICES, "volume"))))
def null_profile(spark, sf):
    return quality.null_profile(clean.align(bars(spark, sf)).select("ticker", "date", *PRICES, "volume"))


BOX = "SELECT ticker, " + ", ".join(f"quantile_cont(close, {p}) AS {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " FROM bars GROUP BY 1"
IN = "close BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5"


@query("box_stats", using("bars", f"""SELECT b.ticker, {r('max(q1)', 4)} AS q1, {r('max(median)', 4)} AS median, {r('max(q3)', 4)} AS q3,
    min(close) FILTER ({IN}) AS whisker_low, max(close) FILTER ({IN}) AS whisker_high, count(*) FILTER (NOT ({IN})) AS outside
    FROM bars b JOIN q ON q.ticker = b.ticker GROUP BY 1""", q=BOX))
def box_stats(spark, sf):
    return rounded(stats.box_stats(bars(spark, sf)), ["q1", "median", "q3"], 4)


@query("density_curve", using("bars", f"""SELECT ticker, CAST(point AS INTEGER) AS point, {r('max(x)', 4)} AS x, {r('sum(w) * 1e6')} AS density_ppm FROM (
    SELECT b.ticker, point, x, exp(-0.5 * ((x - close) / bw) * ((x - close) / bw)) / (n * bw * sqrt(2 * pi())) AS w
    FROM bars b JOIN g ON g.ticker = b.ticker) GROUP BY 1, 2""",
    s="SELECT ticker, count(close) AS n, min(close) AS lo, max(close) AS hi, stddev_samp(close) * pow(count(close), -0.2) AS bw FROM bars GROUP BY 1",
    g="SELECT ticker, n, bw, point, lo - 3 * bw + (hi - lo + 6 * bw) * point / 199 AS x FROM s CROSS JOIN range(200) t(point)"))
def density_curve(spark, sf):
    out = stats.density_curve(bars(spark, sf))
    return out.select("ticker", "point", rnd("x", 4).alias("x"), rnd(F.col("density") * 1e6).alias("density_ppm"))


@query("missing_map", using("panel", " UNION ALL ".join(
    f"SELECT ticker, date, '{c}' AS field, {c} IS NULL AS is_null FROM panel" for c in PRICES)))
def missing_map(spark, sf):
    return quality.missing_map(clean.align(bars(spark, sf)), PRICES)


def crit(b):
    return r(f"{b[0]} + {b[1]} / nobs + {b[2]} / (nobs * nobs) + {b[3]} / (nobs * nobs * nobs)")


@query("adf_lag0", using("ret", f"""SELECT ticker, {r('adf')} AS adf_stat, 0 AS used_lag, nobs,
    {', '.join(f'{crit(b)} AS {n}' for n, b in stats.CRITICAL.items())},
    CASE WHEN adf < {stats.CRITICAL['crit_5'][0]} + {stats.CRITICAL['crit_5'][1]} / nobs THEN 'Yes' ELSE 'No' END AS stationary
    FROM (SELECT ticker, count(*) AS nobs, regr_slope(d, x) / sqrt((regr_syy(d, x) - regr_slope(d, x) * regr_sxy(d, x))
    / (count(*) - 2) / regr_sxx(d, x)) AS adf FROM (SELECT ticker, y - x AS d, x FROM (SELECT ticker, close_log_return AS y,
    lag(close_log_return) OVER (PARTITION BY ticker ORDER BY date) AS x FROM ret) WHERE x IS NOT NULL) GROUP BY 1)"""))
def adf_lag0(spark, sf):
    return rounded(stats.adf_lag0(bars(spark, sf)), ["adf_stat", *stats.CRITICAL])


@query("adf_test")
def adf_test(spark, sf):
    return stats.adf_test(bars(spark, sf))


@query("cross_corr", using("ret", f"""SELECT x.ticker AS a, y.ticker AS b, count(*) AS n,
    {r('corr(x.close_log_return, y.close_log_return)')} AS corr FROM ret x JOIN ret y ON x.date = y.date AND x.ticker < y.ticker
    WHERE x.close_log_return IS NOT NULL AND y.close_log_return IS NOT NULL GROUP BY 1, 2"""))
def cross_corr(spark, sf):
    rows = R.tiled(features.positioned(bars(spark, sf).select("ticker", "date", "close")), ["ticker"],
                   lambda t, w: features.with_log_returns(t, w, ["close"]), lookback=1)
    return rounded(stats.cross_correlation(rows.select("ticker", "date", "close_log_return")), ["corr"])
