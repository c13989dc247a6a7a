"""Model registry: nested JSON records of exported models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.functions import scalar as X


def records(best: DataFrame, features: Sequence[str], models: DataFrame | None = None,
            lookback: int = S.LOOKBACK, horizon: int = S.HORIZON) -> DataFrame:
    """Registry rows of the best fold per ticker, with that fold's model when ``models`` has it."""
    if models is None:
        best = best.withColumn("parameters", F.lit(None).cast(S.PARAMETERS))
    else:
        held = models.select("ticker", "fold", F.struct(*S.PARAMETERS.names).alias("parameters"))
        best = best.join(held, ["ticker", "fold"], "left")
    metrics = F.struct(*[F.col(f.name).alias(f.name) for f in S.METRICS])
    return best.select(
        "ticker", F.col("fold").cast("bigint").alias("fold"), F.lit(lookback).cast("bigint").alias("lookback"),
        F.lit(horizon).cast("bigint").alias("horizon"), F.lit(len(features)).cast("bigint").alias("n_features"),
        F.array(*[F.lit(f) for f in features]).alias("features"), F.array(F.lit("parameters")).alias("model_formats"),
        metrics.alias("metrics"), F.col("performance").alias("performance_status"),
        F.lit(f"Next-period log returns (H={horizon})").alias("prediction_target"),
        F.lit("StandardScaler").alias("scaler"), "parameters")


def write(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.REGISTRY).option("recursiveFileLookup", True).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Registry written by :func:`write`: one record per line, so files can be split."""
    return spark.read.schema(S.REGISTRY).json(path)


def summary(registry: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Listing of the available models with rounded metrics."""
    m = lambda c: F.col(f"metrics.{c}")
    return registry.select(
        F.col("ticker").alias("symbol"), X.display_name(F.col("ticker"), names).alias("name"),
        F.lit("active").alias("status"), F.round(m("dir_acc") * 100, 1).alias("accuracy"), "performance_status",
        F.round(m("mae"), 6).alias("mae"), F.round(m("rmse"), 6).alias("rmse"), F.round(m("sharpe"), 2).alias("sharpe"),
        F.round(m("max_dd"), 4).alias("max_dd"), F.round(m("ic"), 3).alias("ic"),
        F.round(m("hit_rate"), 3).alias("hit_rate"))


def models(registry: DataFrame) -> DataFrame:
    """Model rows for scoring: ``ticker, mean, scale, weights, intercept``."""
    return registry.where("parameters is not null").select("ticker", "parameters.*")
