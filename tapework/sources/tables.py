"""Keyed tables: upsert, insert-if-absent and database append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.operators import columns as C
from tapework.operators.clean import keep_last
from tapework.session import materialize
from tapework.sources import files
from tapework.sources.versions import Versions

KEYS = ("ticker", "date")


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str] = KEYS, arrival: str | None = None) -> DataFrame:
    """Target with the batch's rows inserted or replaced; the latest arrival in a batch wins.
    A batch may lack columns of the target: existing rows keep theirs, new rows have NULL there.

    Only keys decide which target rows stay, so the target is filtered by an anti-join (against a
    broadcast key list when the batch is measured small) and is never sorted or regrouped.
    """
    rows = batch
    if arrival is not None:
        rows = keep_last(batch, keys, arrival)
        if arrival not in target.columns:
            rows = rows.drop(arrival)
    missing = [c for c in target.columns if c not in rows.columns]
    if missing:  # the batch's columns are set, the others keep what the target has
        rows = rows.join(target.select(*keys, *missing), list(keys), "left")
    return target.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str] = KEYS,
                  arrival: str | None = None) -> DataFrame:
    """Batch rows whose keys the target lacks; the first arrival in a batch wins."""
    rows = batch
    if arrival is not None:
        rest = [c for c in batch.columns if c not in keys]
        rows = (batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), arrival).alias("_r"))
                .select(*keys, "_r.*").select(*batch.columns))
        if arrival not in target.columns:
            rows = rows.drop(arrival)
    return rows.join(target.select(*keys), list(keys), "left_anti")


def upsert_bars(batch: DataFrame, path: str, arrival: str | None = None) -> None:
    """Upsert into a bar table, rewriting only the ticker/year partitions the batch touches.

    The batch is stored once. Its years select the folders to read, and its tickers and years join
    the table's partition columns, so Spark can leave out the other folders when it runs. The merged
    partitions are written to the shared folder first, so the table is never read while it is being
    replaced and a failed run can simply be repeated.
    """
    spark = batch.sparkSession
    batch = materialize(batch, "batch")
    years = batch.agg(F.min(F.year("date")).alias("first"), F.max(F.year("date")).alias("last")).first()
    if years["first"] is None:
        return
    try:
        current = files.read_bars(spark, path, years["first"], years["last"], with_year=True)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        first = batch if arrival is None else keep_last(batch, KEYS, arrival).drop(arrival)
        files.write_bars(C.conform(first), path)
        return
    touched = batch.select("ticker", F.year("date").alias("year")).distinct()
    part = current.join(touched, ["ticker", "year"], "left_semi").drop("year")
    current = current.drop("year")
    files.write_bars(materialize(upsert(part, batch, KEYS, arrival).select(*current.columns), "upsert"), path)


def upsert_versioned(batch: DataFrame, path: str, arrival: str | None = None) -> int:
    """Upsert into a bar table in versions: the ticker and year partitions that the batch touches are
    written anew beside the old ones, and one pointer makes them visible at once. Returns the version."""
    batch = materialize(batch, "batch").withColumn("year", F.year("date"))
    table = Versions(batch.sparkSession, path, ["ticker", "year"])
    newest = lambda rows: rows if arrival is None else keep_last(rows, KEYS, arrival).drop(arrival)
    return table.update(lambda rows: upsert(rows, batch, KEYS, arrival).select(*rows.columns), batch, newest)


def read_versioned(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The bars of a version, the latest one by default."""
    rows = Versions(spark, path, ["ticker", "year"]).read(version).drop("year")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.BAR if f.name in rows.columns])


def append_sql(df: DataFrame, url: str, table: str, partitions: int | None = None, **options: str) -> int:
    """Append to a database table over JDBC from the executors; returns the number of rows."""
    rows = df if partitions is None else df.coalesce(partitions)
    rows.write.mode("append").jdbc(url, table, properties=options)
    return df.count()
