"""Raw landing files, bar tables and report files."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapework import schemas as S
from tapework.operators import columns as C


def path_ticker(path: Column) -> Column:
    """Ticker from ``.../raw/{ticker}/...`` or ``.../raw/ticker={ticker}/...``.

    File paths arrive percent-encoded, and partition folders escape characters once more.
    """
    found = F.regexp_extract(path, r"raw/(?:ticker=)?([^/]+)/", 1)
    plus = lambda c: F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(plus(F.try_url_decode(plus(found))))


def land_raw(bars: DataFrame, prefix: str, ingest_date: str) -> str:
    """Write raw CSV under ``{prefix}/raw/ticker=.../ingest_date=...``; a rerun replaces its own day.

    Files are sized at run time: small tickers share a task, a large one is split over several.
    """
    names = {"date": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close",
             "adj_close": "Adj Close", "volume": "Volume"}
    out = C.conform(bars).select("ticker", F.lit(ingest_date).alias("ingest_date"),
                                 *[F.col(k).alias(v) for k, v in names.items()])
    target = f"{prefix}/raw"
    (out.hint("rebalance", "ticker").write.mode("overwrite").partitionBy("ticker", "ingest_date")
     .option("partitionOverwriteMode", "dynamic").option("header", True).csv(target))
    return target


# A header names its date column; a line of data never does.
_HEADER = r'(?i)(^|,)\s*"?\s*(date|timestamp|datetime)\s*"?\s*(,|$)'


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header lines of a raw tree and the files that begin with each of them.

    The lines are found by their date column, in one scan; what reaches the driver is the list of
    files, which it holds for any read of the tree, and a few kinds of headers.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    found = lines.where(F.col("value").rlike(_HEADER)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    firsts = found.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    out: dict[str, list[str]] = {}
    for r in firsts.orderBy("file").collect():
        out.setdefault(r.header, []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r.file)))
    return out


def read_raw(spark: SparkSession, path: str, default_ticker: str | None = None, with_source: bool = False) -> DataFrame:
    """Raw CSV tree to canonical bars, optionally with each row's file.

    Files may differ in their columns, the order of these and the name of the date (``date``,
    ``timestamp`` or ``datetime``). Columns go by name, missing ones are NULL, others are dropped;
    files without a date column in their header hold no bars.
    """
    parts = []
    for header, names in headers(spark, path).items():
        columns, seen = [], set()
        for k, cell in enumerate(next(csv.reader([header]))):
            name = cell.strip().lower().replace(" ", "_") or f"_c{k}"
            columns.append(name if name not in seen else f"_{k}_{name}")
            seen.add(name)
        raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("header", True).csv(names)
        dated = C.with_date(raw.select("*", F.col("_metadata.file_path").alias("source_file")))
        bars = C.conform(dated.withColumn("ticker", C.default_ticker(path_ticker(F.col("source_file")), default_ticker)).select(
            *[c for c in ("ticker", *dated.columns) if c in S.CANONICAL], "source_file"), ("source_file",))
        parts.append(bars)
    out = parts[0] if parts else spark.createDataFrame([], T.StructType([*S.BAR.fields, T.StructField("source_file", T.StringType())]))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if with_source else out.drop("source_file")


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars by ticker and year, sorted by date inside a file; a rerun replaces the years it holds.

    One folder per ticker and day would leave a file per row, so days are a sort order here.
    Rebalancing splits a large ticker-year over several files instead of one task.
    """
    (bars.withColumn("year", F.year("date")).hint("rebalance", "ticker", "year")
     .sortWithinPartitions("ticker", "year", "date")
     .write.mode("overwrite").partitionBy("ticker", "year")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def read_bars(spark: SparkSession, path: str, first_year: int | None = None, last_year: int | None = None,
              with_year: bool = False) -> DataFrame:
    """Bars table; a range of years reads only those folders."""
    schema = T.StructType([*[f for f in S.BAR if f.name != "ticker"],
                           T.StructField("ticker", T.StringType()), T.StructField("year", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(path)
    if first_year is not None:
        rows = rows.where(F.col("year").between(first_year, last_year))
    return C.conform(rows, ("year",) if with_year else ())


def write_report(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header, optionally one folder per value of ``by``."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Window arrays as Parquet, by ticker."""
    sequences.write.mode("overwrite").partitionBy("ticker").parquet(path)
