"""Training and daily scoring: fit, keep the best fold's model, score the latest bars once a day."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.operators import backtest, clean, columns, features, joins, model, ranking, splits
from tapework.session import materialize
from tapework.sources import registry


def train(bars: DataFrame, path: str, strength: float = 1.0, min_ic: float = 0.03, min_sharpe: float = 1.0) -> DataFrame:
    """Fit every fold, backtest it, and write the best fold per ticker that passes the gate."""
    names = S.training_features()
    rows = materialize(splits.with_segments(features.training_frame(bars)), "training")
    models = materialize(model.ridge_models(rows, names, strengths=[strength]), "models")
    preds = materialize(joins.score_join(splits.test_rows(rows), models, names, backtest.KEYS).select(
        *backtest.KEYS, "date", "pred", F.col("target").alias("actual"), "_pos", "_rows"), "preds")
    folds = materialize(backtest.report(preds), "folds")
    registry.write(registry.records(ranking.best_model(folds, min_ic, min_sharpe), names, models), path)
    return folds


def score_daily(bars: DataFrame, registered: DataFrame, requests: DataFrame, path: str) -> DataFrame:
    """Outcomes of the requested tickers, scored at most once a day: results stored under ``path`` are
    reused for tickers whose latest day they hold, and new ones are added to them, by date."""
    spark = bars.sparkSession
    schema = "ticker string, predicted_log_return double, direction string, error string, date date"
    try:
        stored = spark.read.schema(schema).parquet(path)
        known = stored.where("date IS NOT NULL AND error IS NULL")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    new = materialize(score_latest(bars, registered, requests, known).select(*[c.split()[0] for c in schema.split(", ")]), "outcomes")
    new.where("date IS NOT NULL AND error IS NULL").write.mode("append").partitionBy("date").parquet(path)
    if known is None:
        return new
    asked = known.join(requests.select("ticker").distinct(), "ticker", "left_semi").join(new.select("ticker"), "ticker", "left_anti")
    return new.unionByName(clean.latest(asked, ["ticker"], "date").select(*new.columns))


def score_latest(bars: DataFrame, registered: DataFrame, requests: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Outcome per requested ticker; tickers with a stored result of their latest day are left out."""
    names = S.training_features()
    latest = columns.project_features(clean.latest(features.inference_frame(bars), ["ticker"], "date"), names)
    if stored is not None:
        due = joins.not_yet_scored(latest.select("ticker", "date"), stored)
        latest = latest.join(due, ["ticker", "date"], "left_semi")
        requests = requests.join(stored.join(due.select("ticker"), "ticker", "left_anti").select("ticker"), "ticker", "left_anti")
    scores = joins.score_join(latest, registry.models(registered), names).select("ticker", "pred", "date")
    outcomes = joins.batch_outcomes(requests, registered, scores.drop("date"))
    return outcomes.join(scores.select("ticker", "date"), "ticker", "left")
