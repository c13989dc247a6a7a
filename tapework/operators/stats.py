"""Distribution summaries and the stationarity test."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.operators import features
from tapework.operators import series as R


def describe(df: DataFrame, columns: Sequence[str] = S.PRICES, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per key and column."""
    long = df.select(*keys, *columns).unpivot(list(keys), list(columns), "field", "value").where("value is not null")
    by = [*keys, "field"]
    basic = long.groupBy(*by).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return basic.join(R.quantiles(long, by, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), by)


def box_stats(df: DataFrame, column: str = "close") -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 interquartile ranges) and points outside."""
    box = R.quantiles(df, ["ticker"], column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    value, reach = F.col(column), (F.col("q3") - F.col("q1")) * 1.5
    inside = (value >= F.col("q1") - reach) & (value <= F.col("q3") + reach)
    return (df.select("ticker", column).join(box, "ticker").groupBy("ticker")
            .agg(*[F.max(c).alias(c) for c in ("q1", "median", "q3")],
                 F.min(F.when(inside, value)).alias("whisker_low"),
                 F.max(F.when(inside, value)).alias("whisker_high"),
                 F.count_if(~inside).alias("outside")))


#: Width of a cell in bandwidths, and moments kept of it: the series below is cut off beyond 1e-12.
CELL = 0.25
MOMENTS = 11


def _hermite(k: int, t: Column) -> Column:
    """Hermite polynomial (probabilists') of degree k, by Horner's rule in t squared."""
    terms = np.polynomial.hermite_e.herme2poly([0] * k + [1])[k % 2::2][::-1]
    out = F.lit(float(terms[0]))
    for c in terms[1:]:
        out = out * t * t + F.lit(float(c))
    return out * t if k % 2 else out


def density_curve(df: DataFrame, column: str = "close", points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth n^(-1/5) times the sample deviation.

    Values go to cells of a quarter of the bandwidth, and a cell keeps the sums of the powers of its
    values' distances from its middle, which are formed before the shuffle. With distances in bandwidths,
    t from the middle to a grid point and u to a value, exp(-(t - u)^2 / 2) is exp(-t^2 / 2) times the sum
    over k of He_k(t) u^k / k!, so cells alone meet the grid: the work is rows plus cells x points, and the
    result is the direct sum's to rounding.
    """
    rows = df.where(F.col(column).isNotNull()).select("ticker", F.col(column).alias("_v"))
    shape = rows.groupBy("ticker").agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        (F.stddev_samp("_v") * F.pow(F.count("_v"), F.lit(-0.2))).alias("_bw"))
    low, high, bw = F.col("_lo") - cut * F.col("_bw"), F.col("_hi") + cut * F.col("_bw"), F.col("_bw")
    placed = rows.join(shape, "ticker").withColumn("_cell", F.floor((F.col("_v") - F.col("_lo")) / F.nullif(bw * CELL, F.lit(0.0))))
    middle = F.col("_lo") + (F.col("_cell") + 0.5) * CELL * bw
    placed = placed.select("ticker", "_cell", ((F.col("_v") - middle) / bw).alias("_u"))
    cells = placed.groupBy("ticker", "_cell").agg(F.count(F.lit(1)).cast("double").alias("_m0"), *[
        F.sum(F.expr(" * ".join(["_u"] * k))).alias(f"_m{k}") for k in range(1, MOMENTS)])
    grid = cells.join(shape, "ticker").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = low + (high - low) * F.col("point") / (points - 1)
    grid = grid.select("*", x.alias("x"), ((x - middle) / bw).alias("_t"))
    series = sum((_hermite(k, F.col("_t")) * F.col(f"_m{k}") / math.factorial(k) for k in range(1, MOMENTS)), F.col("_m0"))
    weight = series * F.exp(F.col("_t") * F.col("_t") * -0.5) / (F.col("_n") * bw * F.sqrt(F.lit(2 * np.pi)))
    return (grid.select("ticker", "point", "x", weight.alias("_w"))
            .groupBy("ticker", "point").agg(F.max("x").alias("x"), F.sum("_w").alias("density")))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins over the whole range; the top edge belongs to the last bin."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    place = F.floor((F.col(column) - lo) / F.nullif((hi - lo) / bins, F.lit(0.0))) + 1
    return (df.where(F.col(column).isNotNull())
            .groupBy(F.least(F.lit(bins), F.coalesce(place, F.lit(1))).cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("rows")))


def cross_correlation(returns: DataFrame, value: str = "close_log_return", block_days: int = 64, tile: int = 256) -> DataFrame:
    """Correlation of every two tickers over their common dates.

    Dates are cut into blocks and tickers into tiles of about ``tile``; a block of dates contributes
    sums per pair of tiles from a small matrix product, so a task holds two tiles of one block
    whatever the number of tickers, and the row pairs of a date are never written out.
    """
    shape = "a string, b string, n double, sa double, sb double, saa double, sbb double, sab double"

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="ticker", values=value).sort_index(axis=1)
        names, x = np.array(wide.columns), wide.to_numpy(dtype=float)
        have = ~np.isnan(x)
        x, m = np.where(have, x, 0.0), have.astype(float)
        i, j = np.triu_indices(len(names), 1)
        low, high = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        if low != high:  # pairs inside one tile belong to that tile's own group
            home = pdf.groupby("ticker")["_tile"].first().reindex(names).to_numpy()
            across = home[i] != home[j]
            i, j = i[across], j[across]
        pick = lambda left, right: (left.T @ right)[i, j]
        return pd.DataFrame({"a": names[i], "b": names[j], "n": pick(m, m), "sa": pick(x, m), "sb": pick(m, x),
                             "saa": pick(x * x, m), "sbb": pick(m, x * x), "sab": pick(x, x)})

    # Values less their ticker's mean: sums of squares and products keep their digits.
    rows = returns.where(F.col(value).isNotNull()).select("ticker", "date", value)
    means = rows.groupBy("ticker").agg(F.avg(value).alias("_mean"))
    rows = rows.join(means, "ticker").select("ticker", "date", (F.col(value) - F.col("_mean")).alias(value))
    tiles = max(1, -(-rows.agg(F.count_distinct("ticker")).first()[0] // tile))
    own = F.pmod(F.xxhash64("ticker"), F.lit(tiles)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda t: F.struct(
        F.least(t, F.col("_tile")).alias("_i"), F.greatest(t, F.col("_tile")).alias("_j")))
    blocks = rows.select("ticker", "date", value, F.floor(F.unix_date("date") / block_days).alias("_block"), own.alias("_tile")).select(
        "*", F.inline(pairs))
    total = blocks.groupBy("_block", "_i", "_j").applyInPandas(sums, shape).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    var_a = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    var_b = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    return total.where("n > 1").select(
        "a", "b", F.col("n").cast("bigint").alias("n"),
        (cov / F.nullif(F.sqrt(var_a * var_b), F.lit(0.0))).alias("corr"))


# Published response surface for the constant-only test (MacKinnon 2010),
# critical value = b0 + b1/n + b2/n^2 + b3/n^3.
CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}


# Published p-value surface for the constant-only test (MacKinnon 1994); polynomials in
# the statistic below and above -1.61, whose normal distribution function is the p-value.
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
P_SWITCH, P_MIN, P_MAX = -1.61, -18.83, 2.74


def p_value(stat: float) -> float:
    if stat > P_MAX or stat < P_MIN:
        return float(stat > P_MAX)
    powers = P_SMALL if stat <= P_SWITCH else P_LARGE
    return math.erfc(-sum(b * stat**k for k, b in enumerate(powers)) / math.sqrt(2)) / 2


def critical_values(n: Column) -> dict[str, Column]:
    return {name: F.lit(b[0]) + b[1] / n + b[2] / (n * n) + b[3] / (n * n * n) for name, b in CRITICAL.items()}


def _with_returns(bars: DataFrame) -> DataFrame:
    rows = R.tiled(features.positioned(bars.select("ticker", "date", "close")), ["ticker"],
                   lambda r, w: features.with_log_returns(r, w, ["close"]), lookback=1)
    return rows.where("close_log_return is not null").select("ticker", "date", F.col("close_log_return").alias("y"))


def adf_lag0(bars: DataFrame, min_rows: int = 50) -> DataFrame:
    """Unit-root statistic without lagged differences: a t-ratio from regression sums."""
    rows = R.tiled(R.with_position(_with_returns(bars), ["ticker"], ["date"]), ["ticker"],
                   lambda r, w: r.withColumn("x", F.lag("y").over(w)), lookback=1)
    pairs = rows.where("x is not null").withColumn("d", F.col("y") - F.col("x"))
    sums = pairs.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("nobs"), F.regr_slope("d", "x").alias("_b"), F.regr_sxx("d", "x").alias("_sxx"),
        F.regr_sxy("d", "x").alias("_sxy"), F.regr_syy("d", "x").alias("_syy"), F.max(R.ROWS).alias("_n"))
    n = F.col("nobs")
    residual = (F.col("_syy") - F.col("_b") * F.col("_sxy")) / (n - 2)
    out = sums.where(F.col("_n") >= min_rows).withColumn("adf_stat", F.col("_b") / F.sqrt(residual / F.col("_sxx")))
    return (out.withColumns(critical_values(n))
            .select("ticker", "adf_stat", F.lit(0).alias("used_lag"), "nobs", *CRITICAL,
                    F.when(F.col("adf_stat") < F.col("crit_5"), "Yes").otherwise("No").alias("stationary")))


def gram(df: DataFrame, keys: Sequence[str], columns: Sequence[str], flush: int = 512) -> DataFrame:
    """Cross-product sums of (1, columns) per key, upper triangle as rows ``i, j, s``.

    Each task reduces its Arrow batches to one small matrix per key before anything is shuffled.
    """
    keys, columns = list(keys), list(columns)
    source = df.select(*keys, *columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.select(*keys).schema)
    d = len(columns) + 1
    iu, ju = np.triu_indices(d)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def flushed():
            for key, m in sums.items():
                yield pd.DataFrame({**dict(zip(keys, key)), "i": iu.astype("int32"), "j": ju.astype("int32"),
                                    "s": m[iu, ju]})
            sums.clear()

        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                x = np.column_stack([np.ones(len(part)), part[columns].to_numpy(dtype=float)])
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums.get(key, 0.0) + x.T @ x
            if len(sums) >= flush:
                yield from flushed()
        yield from flushed()

    return (source.mapInPandas(partial, f"{kinds}, i int, j int, s double")
            .groupBy(*keys, "i", "j").agg(F.sum("s").alias("s")))


def square(cells, d: int) -> np.ndarray:
    """Symmetric matrix from upper-triangle cells."""
    m = np.zeros((d, d))
    for c in cells:
        m[c["i"], c["j"]] = m[c["j"], c["i"]] = c["s"]
    return m


def adf_test(bars: DataFrame, min_rows: int = 50, max_lag: int | None = None) -> DataFrame:
    """Unit-root test with the lag chosen by AIC.

    Candidate lags share the rows that have all of them; the chosen lag is refitted on every row
    it can use. Both fits come from cross-product sums: the shared part is summed in parallel, and
    the few rows before it (at most the largest lag) travel along as arrays.
    """
    returns = R.with_position(_with_returns(bars), ["ticker"], ["date"])
    limit = F.least(F.ceil(12 * F.pow(F.col(R.ROWS) / 100, F.lit(0.25))), F.floor(F.col(R.ROWS) / 2) - 2)
    if max_lag is None:
        longest = bars.groupBy("ticker").count().agg(F.max("count")).first()[0]
        max_lag = int(np.ceil(12 * (longest / 100) ** 0.25))

    def lagged(rows, w):
        rows = rows.withColumn("x", F.lag("y").over(w)).withColumn("d0", F.col("y") - F.col("x"))
        return rows.withColumns({f"d{k}": F.lag("d0", k).over(w) for k in range(1, max_lag + 1)})

    names = ["x", *[f"d{k}" for k in range(1, max_lag + 1)], "d0"]
    rows = (R.tiled(returns, ["ticker"], lagged, lookback=max_lag + 1)
            .where((F.col(R.ROWS) >= min_rows) & F.col("x").isNotNull())
            .withColumn("_p", F.least(limit, F.lit(max_lag))))
    filled = rows.select("ticker", R.POS, "_p", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    # Row t (0-based) has lags 1..t-1 of the differences.
    shared = gram(filled.where(F.col(R.POS) > F.col("_p")), ["ticker"], names)
    cells = shared.groupBy("ticker").agg(F.collect_list(F.struct("i", "j", "s")).alias("cells"))
    early = filled.where(F.col(R.POS) <= F.col("_p")).groupBy("ticker").agg(
        F.collect_list(F.struct(F.col(R.POS).alias("pos"), F.array(*names).alias("v"))).alias("early"),
        F.max("_p").alias("p"))
    d = len(names) + 1

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def fit(m, p):
            use, last = [0, 1, *range(2, 2 + p)], d - 1
            a, b = m[np.ix_(use, use)], m[use, last]
            beta = np.linalg.solve(a, b)
            rss = m[last, last] - beta @ b
            return beta, rss, np.linalg.inv(a)[1, 1], m[0, 0]

        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                m, top = square(row.cells, d), int(row.p)
                n = m[0, 0]
                aic = []
                for p in range(top + 1):
                    _, rss, _, _ = fit(m, p)
                    aic.append(n * (np.log(2 * np.pi * rss / n) + 1) + 2 * (p + 2))
                best = int(np.argmin(aic))
                for e in row.early:
                    if e["pos"] > best:
                        v = np.concatenate([[1.0], e["v"]])
                        m = m + np.outer(v, v)
                beta, rss, inv, n = fit(m, best)
                stat = beta[1] / np.sqrt(rss / (n - best - 2) * inv)
                out.append((row.ticker, float(stat), p_value(stat), best, int(n)))
            yield pd.DataFrame(out, columns=["ticker", "adf_stat", "p_value", "used_lag", "nobs"])

    fitted = cells.join(early, "ticker").mapInPandas(
        solve, "ticker string, adf_stat double, p_value double, used_lag int, nobs bigint")
    return (fitted.withColumns(critical_values(F.col("nobs")))
            .withColumn("stationary", F.when(F.col("p_value") < 0.05, "Yes").otherwise("No")))
