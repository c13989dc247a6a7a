"""Summaries over folds and tickers, rankings and best-of selections.

These reports work on one row per (ticker, fold); the windows here never see series rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapework.functions import scalar as X
from tapework.operators import series as R

AVERAGED = ("mae", "rmse", "ic", "dir_acc", "sharpe", "max_dd", "hit_rate")
SPREAD = ("mae", "rmse", "ic", "dir_acc", "sharpe")


def fold_summary(folds: DataFrame) -> DataFrame:
    """Per-ticker means and sample deviations over folds; missing values are skipped."""
    return folds.groupBy("ticker").agg(
        *[F.avg(c).alias(f"avg_{c}") for c in AVERAGED],
        *[F.nanvl(F.stddev_samp(c), F.lit(None).cast("double")).alias(f"std_{c}") for c in SPREAD])


def overall_summary(folds: DataFrame) -> DataFrame:
    """Averages per ticker with the grade of the averages."""
    return fold_summary(folds).select(
        "ticker", *[f"avg_{c}" for c in AVERAGED],
        X.grade_model(F.col("avg_ic"), F.col("avg_dir_acc"), F.col("avg_sharpe")).alias("status"))


def ticker_summary(folds: DataFrame) -> DataFrame:
    """Walk-forward summary; drawdown is positive there, so the worst is the maximum."""
    return folds.groupBy("ticker").agg(
        F.avg("sharpe").alias("sharpe"), F.max("max_dd").alias("max_dd"), F.avg("hit_rate").alias("hit_rate"),
        F.avg("ic").alias("ic"), F.sum("net_pnl").alias("net_pnl"))


def rank_by(summary: DataFrame, column: str, tie: str = "ticker") -> DataFrame:
    """Tickers ranked by a summary column, best first (one row per ticker)."""
    return R.ordered_rank(summary, [F.col(column).desc_nulls_last(), F.col(tie)])


def best_model(folds: DataFrame, min_ic: float = 0.03, min_sharpe: float = 1.0) -> DataFrame:
    """Best fold per ticker among those that pass the gate; the earlier fold wins a tie."""
    rest = [c for c in folds.columns if c != "ticker"]
    return (folds.where((F.col("ic") > min_ic) & (F.col("sharpe") > min_sharpe))
            .groupBy("ticker").agg(F.max_by(F.struct(*rest), F.struct("sharpe", -F.col("fold"))).alias("_b"))
            .select("ticker", "_b.*"))


def best_trial(trials: DataFrame, keys=("ticker", "fold"), config: str = "trial", loss: str = "loss") -> DataFrame:
    return trials.groupBy(*keys).agg(
        F.min_by(config, F.struct(loss, config)).alias(config), F.min(loss).alias(loss))


def portfolio_stats(summary: DataFrame, status: str = "Exceptional") -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("models"), F.count_if(F.col("status") == status).alias("alpha_models"),
        F.avg("avg_sharpe").alias("avg_sharpe"), F.avg("avg_ic").alias("avg_ic"),
        F.count_if(F.col("avg_sharpe").isNotNull()).alias("active"), F.avg("avg_dir_acc").alias("avg_accuracy"))


def first_available(rows: DataFrame, keys, priority: Column) -> DataFrame:
    """Rows of the first source in priority order that has any, per key.

    The best priority per key is a small aggregate joined back, so no key's rows are grouped.
    """
    ranked = rows.withColumn("_p", priority)
    best = ranked.groupBy(*keys).agg(F.min("_p").alias("_p"))
    return ranked.join(best, [*keys, "_p"], "left_semi").drop("_p")
