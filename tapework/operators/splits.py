"""Time-ordered splits, as arithmetic on positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.operators import series as R


def segment(n_splits: int = S.N_SPLITS) -> Column:
    """0 for the first training block, i+1 for the test block of fold i.

    Expanding folds share their rows: the training rows of fold i are segments 0..i, so
    statistics of a fold are sums over segments and no row has to be copied per fold.
    """
    size = F.expr(f"{R.ROWS} div {n_splits + 1}")
    first = F.col(R.ROWS) - n_splits * size
    return (F.when(F.col(R.POS) < first, F.lit(0))
            .otherwise(F.floor((F.col(R.POS) - first) / size) + 1).cast("bigint"))


def with_segments(df: DataFrame, order: str = "date", n_splits: int = S.N_SPLITS) -> DataFrame:
    return R.with_position(df, ["ticker"], [order]).withColumn("segment", segment(n_splits))


def test_rows(segmented: DataFrame, n_splits: int = S.N_SPLITS) -> DataFrame:
    """Test rows with their fold; positions restart in each fold."""
    size = F.expr(f"{R.ROWS} div {n_splits + 1}")
    start = F.col(R.ROWS) - n_splits * size + (F.col("segment") - 1) * size
    return (segmented.where("segment > 0").withColumn("fold", F.col("segment") - 1)
            .withColumn(R.POS, F.col(R.POS) - start).withColumn(R.ROWS, size).drop("segment"))


def expanding(df: DataFrame, order: str = "date", n_splits: int = S.N_SPLITS) -> DataFrame:
    """One row per (row, fold) with its role; the explicit form of the split."""
    rows = with_segments(df, order, n_splits)
    folds = F.explode(F.sequence(F.greatest(F.col("segment") - 1, F.lit(0)), F.lit(n_splits - 1)))
    return (rows.withColumn("fold", folds)
            .withColumn("role", F.when(F.col("segment") == F.col("fold") + 1, "test").otherwise("train"))
            .drop("segment"))


def fold_sizes(df: DataFrame, order: str = "date", n_splits: int = S.N_SPLITS) -> DataFrame:
    """Train and test rows per fold, from the series length alone."""
    size = F.expr(f"n div {n_splits + 1}")
    return (df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
            .select("ticker", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_splits - 1).cast("bigint"))).alias("fold"),
                    "n", size.alias("test_rows"))
            .select("ticker", "fold",
                    (F.col("n") - (n_splits - F.col("fold")) * F.col("test_rows")).alias("train_rows"), "test_rows"))


def walk_forward(df: DataFrame, order: str = "date", start: int = S.LOOKBACK, step: int = S.WALK_STEP) -> DataFrame:
    """Test rows of each walk-forward fold. Fold f trains on the rows before start + f*step,
    given as ``train_rows``, so the growing training sets are never written out."""
    rows = R.with_position(df, ["ticker"], [order])
    fold = F.expr(f"({R.POS} - {start}) div {step}")
    return (rows.where(F.col(R.POS) >= start).withColumn("fold", fold)
            .withColumn("train_rows", F.col("fold") * step + start)
            .where(F.col("train_rows") + step <= F.col(R.ROWS)))


def min_history(df: DataFrame, rows: int = S.LOOKBACK + S.WALK_STEP) -> DataFrame:
    """Rows of tickers with enough history."""
    enough = df.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= rows)
    return df.join(enough.select("ticker"), "ticker", "left_semi")
