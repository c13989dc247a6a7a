"""Forecast and backtest job: from bars to a ranked report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tapework.operators import backtest, model, ranking
from tapework.session import materialize


def predictions(bars: DataFrame, walk_forward: bool = False) -> DataFrame:
    """Out-of-sample predictions. The lagged frame and the predictions are each written once,
    because the steps after them read them several times."""
    frame = materialize(model.lag_frame(bars), "lags")
    made = model.walk_forward_forecast(frame) if walk_forward else model.ols1_forecast(frame)
    return materialize(made, "preds")


def fold_report(bars: DataFrame, convention: str = "flat") -> DataFrame:
    return backtest.report(predictions(bars, walk_forward=convention != "flat"), convention)


def ranked_report(bars: DataFrame) -> DataFrame:
    """Per-ticker averages, grade and rank by Sharpe."""
    return ranking.rank_by(ranking.overall_summary(fold_report(bars)), "avg_sharpe")
