"""Connected components of a link table by alternating large-star and small-star rounds.

Links stay in tables; the driver sees only their number and a checksum. Each round is two grouped
minima and two joins, all with map-side combining or splittable skew, so a hub with a third of the
links is no single task. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapework.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("hub"), F.least("a", "low").alias("low"))
    return (both.where("b > a").join(low, F.col("a") == F.col("hub"))
            .select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest one (a > b holds)."""
    low = links.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "hub")
    moved = links.join(low, F.col("a") == F.col("hub")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select(F.col("hub").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)`` for every node that has a link to another node; ``root``
    is the smallest node reachable. NULL ends and self links are ignored; repeats do no harm."""
    current = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .where("a <> b").distinct(), "links")
    before = _mark(current)
    for _ in range(rounds):
        if not before[0]:
            break
        current = stored(_small_star(_large_star(current)), "links")
        now = _mark(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
