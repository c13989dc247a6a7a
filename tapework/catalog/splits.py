"""Queries: time-ordered splits."""

from tapework.catalog.base import query, using
from tapework.operators import splits
from tapework.sources.fixtures import bars

NUMBERED = """SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS pos,
    count(*) OVER (PARTITION BY ticker) AS n FROM bars"""


@query("ts_split", using("bars folds", """SELECT ticker, fold, date, CASE WHEN pos < n - (4 - fold) * (n // 5) THEN 'train'
    ELSE 'test' END AS role FROM b CROSS JOIN folds WHERE pos < n - (3 - fold) * (n // 5)""", b=NUMBERED))
def ts_split(spark, sf):
    return splits.expanding(bars(spark, sf).select("ticker", "date")).select(
        "ticker", "fold", "date", "role").selectExpr("ticker", "cast(fold as bigint) fold", "date", "role")


@query("walk_forward_split", using("bars", """SELECT ticker, date, fold, fold * 25 + 200 AS train_rows FROM (
    SELECT *, (pos - 200) // 25 AS fold FROM b WHERE pos >= 200) WHERE fold * 25 + 225 <= n""", b=NUMBERED))
def walk_forward_split(spark, sf):
    return splits.walk_forward(bars(spark, sf).select("ticker", "date")).select("ticker", "date", "fold", "train_rows")


@query("min_history", using("bars", """SELECT ticker, count(*) AS rows, max(date) AS last_date FROM bars
    GROUP BY 1 HAVING count(*) >= 225"""))
def min_history(spark, sf):
    from pyspark.sql import functions as F
    return splits.min_history(bars(spark, sf)).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.max("date").alias("last_date"))


@query("fold_sizes", using("bars folds", """SELECT ticker, fold,
    count(*) FILTER (pos < n - (4 - fold) * (n // 5)) AS train_rows,
    count(*) FILTER (pos >= n - (4 - fold) * (n // 5) AND pos < n - (3 - fold) * (n // 5)) AS test_rows
    FROM b CROSS JOIN folds GROUP BY 1, 2""", b=NUMBERED))
def fold_sizes(spark, sf):
    return splits.fold_sizes(bars(spark, sf))
