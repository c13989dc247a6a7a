"""Secret scans by linking the parts of a credential. DataFrame functions only.

Base findings are strong by themselves (assignments, access identifiers, long hex strings). Weak
candidates (a bare 40-character key, an endpoint address) are everywhere in clean text, so they are
reported only next to their complement: a key within the scope of an access identifier, an endpoint
within the scope of an access identifier that also has a key or an assignment. Scopes are intervals
of ``SCOPE`` characters around an identifier; identifiers and candidates meet in an interval join on
bins of that width, inside one document.

A match's position is the length of all text before it: the text is split at the matches, and
lengths of gaps and matches are added up. Lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapework.llm.common import prepare, span_text, stored

# The patterns of the base findings and their least lengths, and of the weak parts.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
          r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KEY = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[A-Za-z0-9._~:@/?#%&=+-]*[A-Za-z0-9/]"
ASSIGN_VALUE = 12
SCOPE = 400
#: Order of kinds at one position.
KINDS = ("assign", "access", "hex", "key", "endpoint")

#: Matches are added up in pieces, so that positions of n matches cost n times the piece, not n squared.
_PIECE = 64
_SPAN = "struct<start:bigint,kind:int,stop:bigint,ok:boolean>"


def _spans(text: Column, pattern: str, kind: str, value: int | None = None) -> Column:
    """Array of (start, kind, stop, ok) of all matches, in text order. ``value``: group whose
    length must reach ``ASSIGN_VALUE``, else ``ok`` is false."""
    n = F.lit(KINDS.index(kind))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # Parameters and look-arounds see the same text in both calls, so gaps and matches interleave.
    good = (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value)), lambda v: F.char_length(v) >= ASSIGN_VALUE)
            if value else F.transform(matches, lambda m: F.lit(True)))
    steps = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(
        F.char_length(g).cast("long").alias("gap"), F.char_length(m).cast("long").alias("len"))), good,
        lambda s, ok: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), ok.alias("ok")))

    def piece(at: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), n.alias("kind"),
                                                  (acc["at"] + s["gap"] + s["len"]).alias("stop"), s["ok"].alias("ok")))).alias("out")))

    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(steps) - 1) / _PIECE).cast("int"))),
                         lambda i: F.slice(steps, i * _PIECE + 1, _PIECE))
    whole = F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out")),
                        lambda acc, p: F.transform(F.array(piece(acc["at"], p)), lambda r: F.struct(
                            r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0])
    return F.flatten(whole["out"])


def _found(text: Column, cue: Column, pattern: str, kind: str, value: int | None = None) -> Column:
    """Spans where the cheap ``cue`` holds; an empty array elsewhere."""
    return F.when(cue, _spans(text, pattern, kind, value)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _named(spans: Column) -> Column:
    """Spans by start, then kind as listed, with the kind's name."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(F.array_sort(spans), lambda s: F.struct(
        names[s["kind"]].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: ``doc_id``, ``row_key`` (equal only for equal rows), the base
    spans and the weak candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = F.col("_text")
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    has_access = t.contains("AKIA")
    out = base.select(
        "doc_id",
        F.when(has_access, F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), t).cast("binary"), 256)).alias("row_key"),
        F.filter(_found(t, t.rlike(ASSIGN), ASSIGN, "assign", 2), lambda s: s["ok"]).alias("assign"),
        _found(t, has_access, ACCESS, "access").alias("access"),
        _found(t, t.rlike(HEX), HEX, "hex").alias("hex"),
        # Weak parts matter only where an identifier is.
        F.concat(_found(t, has_access, KEY, "key"), _found(t, has_access & t.contains("://"), ENDPOINT, "endpoint")).alias("weak"))
    return out


def _near(ids: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """Pairs (row_key, id, part) whose intervals are at most ``scope`` characters apart: a join on
    bins of that width, the candidate standing in its own bin, the identifier in all it reaches."""
    reach = ids.select("row_key", F.col("span").alias("id"), F.explode(F.sequence(
        F.floor((F.col("span.start") - scope) / scope), F.floor((F.col("span.stop") + scope) / scope))).alias("bin"))
    held = others.select("row_key", F.col("span").alias("part"), F.explode(F.sequence(
        F.floor(F.col("span.start") / scope), F.floor(F.col("span.stop") / scope))).alias("bin"))
    return (reach.hint("merge").join(held, ["row_key", "bin"])
            .where((F.col("part.start") <= F.col("id.stop") + scope) & (F.col("part.stop") >= F.col("id.start") - scope))
            .select("row_key", "id", "part").distinct())


def linked(narrow: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(row_key, added)``: the weak candidates that a complement confirms."""
    some = narrow.where(F.exists("access", lambda s: s["ok"]) & (F.size("weak") > 0)).dropDuplicates(["row_key"])
    ids = some.select("row_key", F.explode("access").alias("span"))
    weak = some.select("row_key", F.explode("weak").alias("span"))
    strong = some.select("row_key", F.explode("assign").alias("span"))
    key, endpoint = KINDS.index("key"), KINDS.index("endpoint")
    pairs = _near(ids, weak.union(strong), scope)
    # Identifiers with a secret, be it a bare key or an assignment.
    whole = pairs.where(F.col("part.kind") != endpoint).select("row_key", "id").distinct()
    keys = pairs.where(F.col("part.kind") == key).select("row_key", "part")
    ends = pairs.where(F.col("part.kind") == endpoint).join(whole, ["row_key", "id"], "left_semi").select("row_key", "part")
    return keys.union(ends).groupBy("row_key").agg(F.collect_set("part").alias("added"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document with counts and spans of its secrets.

    ``base_sha256`` covers the base findings, ``spans`` those and the linked ones (kinds ``key`` and
    ``endpoint``), ``n_linked`` counts the latter. NULL texts are empty and have no spans; repeated
    rows give equal results; other columns are ignored. Weak candidates that overlap a base finding
    are that finding and are not repeated.
    """
    prepare(docs.sparkSession)
    narrow = stored(parts(docs, id_col, text_col), "secret-parts")
    base = F.concat("assign", "access", "hex")
    free = narrow.withColumn("weak", F.filter("weak", lambda w: ~F.exists(base, lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"]))))
    added = linked(free, scope).withColumnRenamed("row_key", "_key")
    # Rows without an identifier have no key and no links: left out of the join, they do not meet in one task.
    none = F.array().cast(f"array<{_SPAN}>")
    keyed = narrow.where("row_key IS NOT NULL").join(added, F.col("row_key") == F.col("_key"), "left").drop("_key").withColumn(
        "added", F.coalesce("added", none))
    out = keyed.unionByName(narrow.where("row_key IS NULL").withColumn("added", none))
    return out.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"), F.sha2(span_text(_named(base)).cast("binary"), 256).alias("base_sha256"),
        span_text(_named(F.concat(base, "added"))).alias("spans"), F.size("added").cast("long").alias("n_linked"))
