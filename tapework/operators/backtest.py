"""Backtest of predictions under two cost conventions.

``flat``: position is the sign of the prediction, a flat cost whenever it changes, drawdown is
negative, hits are positive net returns, Sharpe of a flat series is 0.
``turnover``: tiny predictions give no position, cost scales with the change of position,
drawdown is positive, hits are matching signs, Sharpe of a flat series is missing.

Input rows are ``ticker, fold, date, pred, actual`` with positions inside the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.functions import metrics as M
from tapework.functions import scalar as X
from tapework.operators import series as R

KEYS = ["ticker", "fold"]
DEAD_BAND = 1e-5


def position(convention: str = "flat") -> Column:
    sign = F.signum("pred")
    return sign if convention == "flat" else F.when(F.abs("pred") < DEAD_BAND, F.lit(0.0)).otherwise(sign)


def cost(convention: str = "flat", rate: float = S.COST) -> Column:
    change = F.col("position") - F.col("previous")
    return F.when(change != 0, F.lit(rate)).otherwise(F.lit(0.0)) if convention == "flat" else F.abs(change) * rate


def numbered(preds: DataFrame) -> DataFrame:
    return preds if R.POS in preds.columns else R.with_position(preds, KEYS, ["date"])


def net_returns(preds: DataFrame, convention: str = "flat", rate: float = S.COST,
                keep_block: bool = False) -> DataFrame:
    """Add ``position, previous, cost, net``."""
    def build(rows, w):
        rows = rows.withColumn("position", position(convention))
        rows = rows.withColumn("previous", F.lag("position", 1, 0.0).over(w))
        rows = rows.withColumn("cost", cost(convention, rate))
        return rows.withColumn("net", F.col("position") * F.col("actual") - F.col("cost"))
    return R.tiled(numbered(preds), KEYS, build, lookback=1, block_rows=R.RUN_ROWS, keep_block=keep_block)


def cumulative(preds: DataFrame, convention: str = "flat", rate: float = S.COST) -> DataFrame:
    """Add the running profit ``cum`` of each fold."""
    return R.running(net_returns(preds, convention, rate, keep_block=True), KEYS, {"cum": ("sum", "net")})


def drawdown(preds: DataFrame, convention: str = "flat", rate: float = S.COST) -> DataFrame:
    """Deepest fall of the running profit below its running maximum, per fold.

    Each block is reduced to its total, highest and lowest partial sum and its own deepest fall;
    blocks are then combined with what came before them, one row per block.
    """
    nets = net_returns(preds, convention, rate, keep_block=True).select(*KEYS, R.BLOCK, R.POS, "net")
    local = Window.partitionBy(*KEYS, R.BLOCK).orderBy(R.POS).rowsBetween(Window.unboundedPreceding, 0)
    summary = (
        nets.withColumn("_cum", F.sum("net").over(local))
        .withColumn("_top", F.max("_cum").over(local))
        .groupBy(*KEYS, R.BLOCK)
        .agg(F.sum("net").alias("_total"), F.max("_cum").alias("_high"), F.min("_cum").alias("_low"),
             F.min(F.col("_cum") - F.col("_top")).alias("_fall"))
    )
    earlier = Window.partitionBy(*KEYS).orderBy(R.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        summary.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)))
        .withColumn("_peak", F.max(F.col("_before") + F.col("_high")).over(earlier))
    )
    deepest = F.min(F.least(F.col("_fall"), F.col("_before") + F.col("_low") - F.col("_peak")))
    return carried.groupBy(*KEYS).agg(
        (deepest if convention == "flat" else F.abs(deepest)).alias("max_dd"))


def summary_metrics(preds: DataFrame, convention: str = "flat", rate: float = S.COST) -> DataFrame:
    """Sharpe, hit rate and profit per fold, with the forecast errors."""
    hit = F.col("net") > 0 if convention == "flat" else F.signum("pred") == F.signum("actual")
    return net_returns(preds, convention, rate).groupBy(*KEYS).agg(
        M.mae().alias("mae"), M.rmse().alias("rmse"), M.directional_accuracy().alias("dir_acc"),
        M.sharpe("net", convention == "flat", S.PERIODS_PER_YEAR).alias("sharpe"),
        F.avg(hit.cast("double")).alias("hit_rate"), F.sum("net").alias("net_pnl"),
        M.ic_pearson().alias("ic"),
    )


def rank_ic(preds: DataFrame) -> DataFrame:
    """Rank correlation with average ties, per fold."""
    # Ranks relative to their mean. Equal pairs of values are merged before the joins, so a value that
    # a third of the rows share (a flat market) is a few rows there.
    place = lambda side: R.value_ranks(preds, KEYS, side).select(
        *KEYS, side, (F.col("smaller") + (F.col("count") + 1) / 2 - (F.col("total") + 1) / 2).alias(f"_r_{side}"))
    pairs = preds.where("pred IS NOT NULL AND actual IS NOT NULL").groupBy(*KEYS, "pred", "actual").agg(F.count(F.lit(1)).alias("_w"))
    a, b, w = F.col("_r_pred"), F.col("_r_actual"), F.col("_w")
    spread = F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))
    return (pairs.join(place("pred"), [*KEYS, "pred"]).join(place("actual"), [*KEYS, "actual"])
            .groupBy(*KEYS).agg((F.sum(w * a * b) / F.nullif(spread, F.lit(0.0))).alias("ic")))


def report(preds: DataFrame, convention: str = "flat", rate: float = S.COST) -> DataFrame:
    """One row per fold with every metric; ``flat`` uses the rank correlation and a grade."""
    preds = numbered(preds)
    base = summary_metrics(preds, convention, rate).join(drawdown(preds, convention, rate), KEYS)
    if convention != "flat":
        return base.select(*KEYS, "sharpe", "max_dd", "hit_rate", "ic", "net_pnl")
    graded = base.drop("ic").join(rank_ic(preds), KEYS, "left")
    return graded.select(
        *KEYS, "mae", "rmse", "ic", "dir_acc", "sharpe", "max_dd", "hit_rate", "net_pnl",
        X.grade_model(F.col("ic"), F.col("dir_acc"), F.col("sharpe")).alias("performance"))


def equity(preds: DataFrame, as_is: bool = False, rate: float = S.COST) -> DataFrame:
    """Running profit per ticker over its folds, or (``as_is``) over all tickers in a row."""
    nets = net_returns(preds, "turnover", rate)
    folds = numbered(preds).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("ticker").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    starts = folds.select(*KEYS, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_start"))
    rows = nets.join(starts, KEYS).withColumn(R.POS, F.col(R.POS) + F.col("_start"))
    own = R.running(rows, ["ticker"], {"equity": ("sum", "net")}).drop("_start")
    if not as_is:
        return own
    # Over all tickers: a ticker starts where the ones before it end. One row per ticker is ordered.
    along = Window.orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)
    ends = nets.groupBy("ticker").agg(F.sum("net").alias("_t")).select("ticker", F.coalesce(F.sum("_t").over(along), F.lit(0.0)).alias("_from"))
    return own.join(ends, "ticker").withColumn("equity", F.col("equity") + F.col("_from")).drop("_from")


def pnl_log(preds: DataFrame, convention: str = "turnover", rate: float = S.COST) -> DataFrame:
    return net_returns(preds, convention, rate).select(
        "date", *KEYS, F.col("pred").alias("prediction"), "actual", "position", F.col("net").alias("net_pnl"))
