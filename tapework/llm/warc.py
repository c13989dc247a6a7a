"""WARC archives: write pages as records, resolve equal payloads to revisits, read back.

Records are written by Spark's text writer with the record separator as line separator, so archives
land on any file system Spark knows, in gzip files of at most ``RECORDS`` records. They are read as
binary files, one file to a task at a time, and parsed by ``Content-Length`` alone, so payloads may
hold any bytes, separators and record headers included.

``revisits`` works on headers: they are shuffled by payload digest, the record with the largest page
id among equal payloads is the original, and a second archive is written in which the others are
revisit records with fresh headers that name it. ``resolved`` joins revisits of an archive back to
the records they name.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapework.llm.common import prepare, stored
from tapework.session import scratch

#: Records to a file, which bounds what a reading task holds compressed at once.
RECORDS = 2000
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Written as WARC-Date unless given; fixed so that reruns write equal archives.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = "page_id long, url string, record_id string, record_type string, refers string, digest string, payload_bytes long"
HEADERS = _FIELDS + ", sha1 string"
RECORD = _FIELDS + ", payload string"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing where the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(kind: Column, date: str) -> Column:
    """The record of a row with page_id, url, record_id, refers, digest, payload_bytes, payload."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(kind == "response", F.concat(http, "payload")).otherwise(http)
    # Control characters and blanks would break the header line.
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", target),
        _line("WARC-Refers-To", F.col("refers")),
        _line("WARC-Profile", F.when(kind == "revisit", F.lit(PROFILE))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("X-Page-Id", F.col("page_id").cast("string")), _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def _write(records: DataFrame, path: str, date: str) -> str:
    (records.select(_record(F.col("record_type"), date).alias("value")).write
     .option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path))
    return path


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", date: str = DATE) -> str:
    """Every page as a response record. NULL html is an empty payload, a NULL url has no target line."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    digest = F.sha1(payload.cast("binary"))
    uuid = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.col(url_col), digest).cast("binary"))
    return _write(pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.concat(F.lit("<urn:uuid:"), F.regexp_replace(uuid, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">")).alias("record_id"),
        F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers"), digest.alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), payload.alias("payload")), path, date)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of an unpacked stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def _reader(with_payload: bool):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(content: bytes):
            for f, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                payload = block.partition(b"\r\n\r\n")[2]
                last = payload.decode("utf-8") if with_payload else (
                    hashlib.sha1(payload).hexdigest() if f["warc-type"] == "response" else None)
                yield (int(f["x-page-id"]) if "x-page-id" in f else None, f.get("warc-target-uri"), f["warc-record-id"],
                       f["warc-type"], f.get("warc-refers-to"), f["warc-payload-digest"].removeprefix("sha1:"),
                       int(f["x-payload-length"]), last)

        names = ["page_id", "url", "record_id", "record_type", "refers", "digest", "payload_bytes", "payload" if with_payload else "sha1"]
        for frame in frames:
            for content in frame["content"]:
                some, size = [], 0
                for row in rows(content):
                    some.append(row)
                    size += len(row[-1] or "")
                    if len(some) >= 512 or size > 8 << 20:
                        yield _framed(some, names)
                        some, size = [], 0
                if some:
                    yield _framed(some, names)
    return read


def _framed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "payload_bytes": "int64"})


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all records; ``sha1`` is computed from the payload of full records."""
    return _files(spark, path).mapInPandas(_reader(False), HEADERS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Headers and payloads of all records."""
    return _files(spark, path).mapInPandas(_reader(True), RECORD)


def revisits(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> str:
    """Rewrite an archive of full records without repeated payloads.

    Among records with equal payloads of at least ``least_bytes`` bytes those with the largest page
    id stay responses (all of them, if that id is repeated); the others become revisits. Records
    without a page id come after all that have one.
    """
    heads = read_headers(spark, source).where(F.col("payload_bytes") >= least_bytes)
    originals = stored(heads.groupBy("digest", "payload_bytes").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top"),
        F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))), "record_id")).alias("original"))
        .where("n > 1").select(F.col("digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "top",
                               F.col("original.record_id").alias("original")), "originals")
    records = read_records(spark, source).join(
        originals, (F.col("digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return _write(records.select(
        "page_id", "url", "record_id", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("original")).alias("refers"), "digest", "payload_bytes", "payload"), target, date)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive with the page id that a revisit refers to. A response whose
    payload does not match its digest raises."""
    heads = stored(read_headers(spark, path), "heads")
    checked = F.when(F.coalesce(F.col("sha1") == F.col("digest"), F.lit(True)), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id")))
    named = heads.where("record_type = 'revisit'").select("refers").distinct()
    full = heads.where("record_type = 'response'").join(named.withColumnRenamed("refers", "record_id"), "record_id", "left_semi").groupBy(
        F.col("record_id").alias("_named")).agg(F.max("page_id").alias("refers_to"))
    # Only revisits are joined; the others name no record and would meet under one NULL key.
    again = heads.where("refers IS NOT NULL").join(full, F.col("refers") == F.col("_named"), "left").drop("_named")
    rows = again.unionByName(heads.where("refers IS NULL").withColumn("refers_to", F.lit(None).cast("long")))
    return rows.select("page_id", "url", "record_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages, rewrite without repeated payloads, and read the result back: one row per page."""
    spark = prepare(pages.sparkSession)
    raw = write_archive(pages, scratch(spark, "warc-raw"), id_col, url_col, html_col)
    return resolved(spark, revisits(spark, raw, scratch(spark, "warc")))
