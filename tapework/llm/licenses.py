"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Candidate units of a file are its lines and its paragraphs that hold a licence cue, and the whole text of
a file named like a licence file. Units and templates are sparse term rows; the cosine is a join on
terms, weighed by inverse document frequencies over all files and over the licences. A file with a unit close enough to a template has that licence itself; a file named like
a licence file gives its licence to its directory, and files without one take that of the nearest
ancestor directory, found by joining the ancestors of all distinct directories.

All of it is DataFrame functions; only terms of cue units are shuffled, never texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapework.llm.common import prepare, stored
from tapework.llm.license_texts import HEADERS, TEXTS

LEAST_COSINE = 0.6
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|copyright|notice|unlicense)([._-].*)?$"
CUE = r"(?i)licen[cs]|copyright|all rights reserved|spdx|warrant|permission|public domain|redistribut|advertising materials"
_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"

#: Whole texts are compared where a file is named like a licence file and has at most so many characters.
WHOLE = 40_000
#: From this score on, the longer unit decides; under it, the better score.
SURE = 0.9

#: Headers, and whole texts as one unit each.
TEMPLATES = (*HEADERS, *((name, " ".join(text.split())) for name, text in TEXTS))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    """``(template, license, term, tf)``; a fixed, small table."""
    rows = [(k, name, text) for k, (name, text) in enumerate(TEMPLATES)]
    return (spark.createDataFrame(rows, "template int, license string, text string")
            .select("template", "license", F.explode(terms(F.col("text"))).alias("term"))
            .groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf")))


def weights(files: DataFrame, words: dict[str, int]) -> tuple[dict[str, float], float]:
    """Weights of the template terms, and of any other term: inverse document frequency over all files (of a
    term found nowhere else) times one over the licences, of which ``words`` has how many hold a term. So
    what tells licences apart, as names and versions do, weighs more than what they share."""
    known = F.array_intersect(F.split(F.regexp_replace(F.lower(F.coalesce("_text", F.lit(""))), r"[^a-z0-9.]+", " "), r"\.?(?: |\z)"), F.lit(sorted(words)))
    counts = files.select(F.explode(F.concat(known, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()  # template terms only
    n = {r.term: r["count"] for r in counts}
    total = n.get("", 0)
    names = len({name for name, _ in TEMPLATES})
    return {w: _idf(total, n.get(w, 0)) * _idf(names, k) for w, k in words.items()}, _idf(total, 0)


def _idf(total: int, n: int) -> float:
    return 1.0 + math.log((1 + total) / (1 + n))


def units(files: DataFrame) -> DataFrame:
    """``(path, unit)`` of ``files(path, _text)``, each once a file: lines and paragraphs that hold a cue, and
    whole texts of files named like a licence file."""
    flat = F.regexp_replace("_text", r"\r\n?", "\n")
    cut = F.concat(F.split(flat, "\n"), F.transform(F.split(flat, r"\n[\x20\t]*\n"), lambda p: F.regexp_replace(p, "\n", " ")))
    plain = F.transform(F.array_distinct(cut), lambda u: F.trim(u))
    named = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)\z", 1).rlike(LICENSE_NAME) & (F.char_length("_text") <= WHOLE)
    whole = F.when(named & (F.trim("_text") != ""), F.array(F.trim(F.regexp_replace("_text", r"\s+", " ")))).otherwise(F.array().cast("array<string>"))
    return (files.where(F.col("_text").rlike(CUE) | named)
            .select("path", F.explode(F.array_distinct(F.concat(F.filter(plain, lambda u: u.rlike(CUE)), whole))).alias("unit")))


def headers(files: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``(path, license, score, tied)`` of the files that state a licence: the best template of their units.

    Units that reach ``SURE`` go before others, longer ones first, so that a whole text or notice decides and
    not a clause that several licences share; below, the better score does. Where templates of different
    licences are equal for the best units, ``license`` is NULL and ``tied`` lists them.
    """
    spark = files.sparkSession
    forms = templates(spark)
    words: dict[str, set[str]] = {}
    for r in forms.select("term", "license").distinct().collect():  # a fixed table
        words.setdefault(r.term, set()).add(r.license)
    idf, other = weights(files, {w: len(names) for w, names in words.items()})
    table = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    weighted = forms.join(table, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norms = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    forms = stored(weighted.join(norms, "template").select("template", "license", "term", (F.col("w") / F.col("t_norm")).alias("t_w"), "idf"), "templates")
    rows = units(files).withColumn("u", F.xxhash64("unit"))
    bag = rows.select("path", "u", F.explode(terms(F.col("unit"))).alias("term")).groupBy("path", "u", "term").agg(F.count(F.lit(1)).alias("tf"))
    bag = stored(bag.join(table, "term", "left").select("path", "u", "term", "tf", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(other))).alias("w")), "units")
    length = bag.groupBy("path", "u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("u_norm"), F.sum("tf").alias("n_terms"))
    dots = bag.join(forms, "term").groupBy("path", "u", "template", "license").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    scores = dots.join(length.withColumnsRenamed({"path": "_p", "u": "_u"}), F.col("path").eqNullSafe(F.col("_p")) & (F.col("u") == F.col("_u"))).withColumn(
        "score", F.round(F.col("dot") / F.col("u_norm"), 9)).where(F.col("score") >= least)
    # A unit's place among a file's units, and each licence's best: as many rows as licences.
    sure = F.when(F.col("score") >= SURE, F.col("n_terms")).otherwise(F.lit(0))
    by_license = scores.groupBy("path", "license").agg(F.max(F.struct(sure.alias("n"), "score")).alias("k"))
    ranked = by_license.groupBy("path").agg(F.max("k").alias("k"), F.collect_list(F.struct("k", "license")).alias("all"))
    tied = F.array_sort(F.transform(F.filter("all", lambda x: x["k"] == F.col("k")), lambda x: x["license"]))
    return ranked.select("path", F.when(F.size(tied) == 1, tied[0]).alias("license"), F.col("k.score").alias("score"),
                         F.when(F.size(tied) > 1, tied).alias("tied"))


def _directory(path: Column) -> Column:
    """Directory of a path without a closing slash; the empty string at the top."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def inherited(files: DataFrame, stated: DataFrame) -> DataFrame:
    """``(dir, license, from_dir)``: for every directory of ``files(path)`` the licence of its own or
    nearest ancestor directory that has a licence file; directories without one are left out."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    given = (stated.where(name.rlike(LICENSE_NAME) & F.col("license").isNotNull()).withColumn("at", _directory(F.col("path")))
             .groupBy("at").agg(F.max(F.struct("score", F.col("license"))).alias("b")).select("at", F.col("b.license").alias("license")))
    dirs = files.select(_directory(F.col("path")).alias("dir")).where("dir IS NOT NULL").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("at"))), F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("at"))))).alias("a")).select("dir", "a.depth", "a.at")
    found = above.join(given, "at").groupBy("dir").agg(F.max(F.struct("depth", "at", "license")).alias("b"))
    return found.select("dir", F.col("b.license").alias("dir_license"), F.col("b.at").alias("from_dir"))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """One row per document: ``doc_id, path, own_license, score, tied, license, from_dir``.

    ``license`` is the document's own, else the inherited one with the directory it comes from, else
    NULL. Where a text fits several licences equally well, ``tied`` lists them and it has none of its own. ``path`` is a column of ``docs`` with ``/`` between directories; documents without a path
    can state but not inherit a licence. NULL and empty texts state none. Rows that share a path are
    one file: its best unit counts. Repeated rows are returned as often as given.
    """
    prepare(docs.sparkSession)
    files = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("_text"))
    stated = stored(headers(files, least), "stated")
    narrow = files.select("doc_id", "path", _directory(F.col("path")).alias("dir"))
    by_dir = stored(inherited(narrow, stated), "by-dir").withColumnRenamed("dir", "_dir")
    own = stated.select(F.col("path").alias("_path"), F.col("license").alias("own_license"), "score", "tied")
    return (narrow.join(own, F.col("path").eqNullSafe(F.col("_path")), "left").join(by_dir, F.col("dir") == F.col("_dir"), "left").select(
        "doc_id", "path", "own_license", "score", "tied", F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("from_dir")))
