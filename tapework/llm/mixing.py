"""Mixing sources to target weights by balanced (cube) sampling.

Targets come from weights by filling: every source's share is proportional to its weight until it
reaches its cap, and what capped sources leave goes to the others.

Every document of a source is wanted ``target / source size`` times. The whole part is taken as it
is; the fraction is an inclusion probability, and the cube method turns the probabilities into 0 or
1 while it keeps the expected number of documents and of words: probabilities move along directions
in the null space of the constraints until one reaches 0 or 1. The flight runs in blocks of bounded
size (a hot source has many blocks); each block leaves at most two undecided documents, which meet
again in the next level, until one block a source is left. Its last undecided documents are decided
by trying the few combinations, and single decisions of that block are reversed while that brings
the words of the source nearer to the target (landing).

Blocks, orders and random numbers come from hashes of the documents, so reruns agree.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapework.llm.common import prepare, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK = 1000
#: Equal rows that are numbered or written out together.
COPIES = 8192
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def words(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0 by ``source`` in code point order, NULL last: ranges are
    sorted side by side, and each adds the number of rows in the ranges before it."""
    sources = stored(sources.repartitionByRange(F.col("source").asc_nulls_last())
                     .sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    counts = {r["_part"]: r["count"] for r in sources.groupBy("_part").count().collect()}  # one row a task
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    w = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for p in before for x in (p, before[p])]), F.col("_part").cast("long")) if before else F.lit(0)
    return sources.withColumn("place", F.row_number().over(w) - 1 + offset).drop("_part")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, source_size, place)`` -> with ``target``. Each pass caps the sources above their
    cap and shares what is left among the others by weight, until none is above."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rows = stored(sources.withColumn("weight", weight).withColumn("top", F.col("source_size") * F.lit(cap)), "weights")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("top") if level else F.lit(False)
        spent, open_weight = rows.agg(F.sum(F.when(full, F.col("top"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        now = (total - (spent or 0.0)) / open_weight
        if now <= level:
            break
        level = now
    return rows.withColumn("target", F.least("top", F.col("weight") * F.lit(level))).drop("weight", "top")


def flight(p: np.ndarray, size: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1 while their sum and the sum of ``p * size`` stay, as far as
    possible: at most two entries stay in between, late ones (so large ones should come first)."""
    p = p.copy()
    live: list[int] = []
    queue = iter(np.nonzero((p > _EPS) & (p < 1 - _EPS))[0].tolist())
    while True:
        while len(live) < 3 and (i := next(queue, None)) is not None:
            live.append(i)
        if len(live) == 3:
            a, b, c = (float(size[i]) for i in live)
            u = (c - b, a - c, b - a)
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
        elif len(live) == 2 and size[live[0]] == size[live[1]]:
            u = (1.0, -1.0)
        else:
            return p
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(live, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(live, u) if v)
        step = up if random.random() * (up + down) < down else -down
        for i, v in zip(live, u):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
        live = [i for i in live if _EPS < p[i] < 1 - _EPS]


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the few entries in between: the combination whose words come nearest, then whose count does."""
    p = p.copy()
    left = np.nonzero((p > _EPS) & (p < 1 - _EPS))[0]
    want, count = float((p[left] * size[left]).sum()), float(p[left].sum())
    p[left] = min(itertools.product((0.0, 1.0), repeat=len(left)),
                  key=lambda z: (abs(float(np.dot(z, size[left])) - want), abs(sum(z) - count), z)) if len(left) else []
    return np.rint(np.where(p <= _EPS, 0, np.where(p >= 1 - _EPS, 1, p)) * 1e9) / 1e9


def settle(p: np.ndarray, size: np.ndarray, want: float, open_: np.ndarray, most: int = 24) -> np.ndarray:
    """Second half of the landing: large documents may leave the words of a source off by part of
    their size, so single decisions among ``open_`` are reversed while that brings the sum nearer."""
    p = p.copy()
    for _ in range(most):
        off = want - float((p * size).sum())
        gain = np.where(open_, abs(off) - np.abs(off - np.where(p > 0.5, -size, size)), -np.inf)
        i = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[i] <= 1e-6:
            break
        p[i] = 1 - p[i]
    return p


def _flown(last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_size", "_tag"], ascending=[False, True], kind="stable").reset_index(drop=True)
        size = frame["_size"].to_numpy(np.float64)
        aim = frame["_p"].to_numpy(np.float64)
        p = flight(aim, size, np.random.default_rng(int(frame["_tag"].min()) & 0x7FFFFFFF))
        if last:
            p = settle(landing(p, size), size, float((aim * size).sum()), (aim > _EPS) & (aim < 1 - _EPS))
        return frame.assign(_p=p)
    return run


def chosen(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """``units(_source, _tag, _size, _p)`` -> ``(_tag, _source, _picked)``; ``_tag`` names a unit."""
    schema = "_source string, _tag long, _size long, _p double, _block int, _last boolean"
    done, level = [], 0
    while True:
        blocks = units.groupBy("_source").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("_n")).withColumnRenamed("_source", "_s")
        dealt = units.join(blocks, F.col("_source").eqNullSafe(F.col("_s"))).select(
            "_source", "_tag", "_size", "_p", F.pmod(F.xxhash64("_tag", F.lit(level)), "_n").cast("int").alias("_block"), (F.col("_n") == 1).alias("_last"))
        dealt = stored(dealt, "dealt")
        groups = [r[0] for r in dealt.select("_last").distinct().collect()]
        flown = [dealt.where(F.col("_last") == F.lit(x)).groupBy("_source", "_block").applyInPandas(_flown(x), schema) for x in groups]
        if not flown:
            break
        out = stored(flown[0] if len(flown) == 1 else flown[0].unionByName(flown[1]), "flown")
        open_ = (F.col("_p") > _EPS) & (F.col("_p") < 1 - _EPS)
        done.append(out.where(~open_).select("_source", "_tag", (F.col("_p") > 0.5).alias("_picked")))
        if False not in groups:
            break
        units = stored(out.where(open_).select("_source", "_tag", "_size", "_p"), "open")
        level += 1
    result = done[0] if done else units.select("_source", "_tag", F.lit(False).alias("_picked"))
    for d in done[1:]:
        result = result.union(d)
    return result


def _tagged(docs: DataFrame, id_col: str, source_col: str, size: Column) -> DataFrame:
    """``docs`` with ``_size`` and ``_tag``, a hash of id, source and size."""
    return docs.withColumn("_size", size).withColumn("_tag", F.xxhash64(
        F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")), "_size"))


def _copies(repeated: DataFrame) -> DataFrame:
    """``(_source, _tag, _copy, _size, _p)``: a unit for each of the ``_n`` rows of a tag, in chunks, so that
    no list is longer than ``COPIES``."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}"))).alias("_chunk")
    first = F.col("_chunk") * COPIES
    return repeated.select("*", chunk).select(
        "_source", "_tag", "_size", "_p", F.explode(F.sequence(first, F.least(first + COPIES, F.col("_n")) - 1)).alias("_k")).select(
        "_source", "_tag", F.xxhash64("_tag", "_k").alias("_copy"), "_size", "_p")


def decisions(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float,
              cap: float, block: int) -> DataFrame:
    """``(_t, _s, _z, source_size, target, _ratio, _n, _k)``: one row per tag, source and size, of whose
    ``_n`` rows ``_k`` are taken once more than the whole part of ``_ratio``."""
    sized = stored(_tagged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")),
                           "doc_id", "source", F.col("size")).select("source", "_size", "_tag"), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("_size").alias("source_size"))
    aims = stored(targets(numbered(by_source), weights, share, cap).drop("place"), "targets")
    units = sized.groupBy("source", "_tag", "_size").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("source", "_source")
    units = stored(units.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("source").withColumn(
        "_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "units")
    open_ = units.where("_size > 0").withColumn("_p", F.col("_ratio") - F.floor("_ratio"))
    flown, repeated = open_.where("_n = 1").select("_source", "_tag", "_size", "_p"), open_.where("_n > 1")
    copies = None
    if not repeated.isEmpty():
        copies = stored(_copies(repeated), "copies")
        flown = flown.unionByName(copies.select("_source", F.col("_copy").alias("_tag"), "_size", "_p"))
    picked = stored(chosen(flown, block), "picked").select(F.col("_tag").alias("_t"), F.col("_source").alias("_s"), F.col("_picked").cast("long").alias("_k"))
    if copies is not None:
        of_tag = copies.join(picked, (F.col("_copy") == F.col("_t")) & F.col("_source").eqNullSafe(F.col("_s"))).groupBy("_tag", "_source").agg(
            F.sum("_k").alias("_k")).select(F.col("_tag").alias("_t"), F.col("_source").alias("_s"), "_k")
        singles = units.where("_n = 1").select(F.col("_tag").alias("_one"), F.col("_source").alias("_of"))
        picked = picked.join(singles, (F.col("_t") == F.col("_one")) & F.col("_s").eqNullSafe(F.col("_of")), "left_semi").unionByName(of_tag)
    return (units.join(picked, (F.col("_tag") == F.col("_t")) & F.col("_source").eqNullSafe(F.col("_s")), "left").select(
        F.col("_tag").alias("_t"), F.col("_source").alias("_s"), F.col("_size").alias("_z"), "source_size", "target", "_ratio", "_n",
        F.coalesce("_k", F.lit(0)).alias("_k")))


def _decided(docs: DataFrame, source_col: str, made: DataFrame) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and ``taken``. Rows of a tag cannot be told apart: they are
    numbered in groups of about ``COPIES``, and a group's share of the ``_k`` goes to its first rows."""
    def joined(some: str) -> DataFrame:
        return docs.withColumn("_salt", F.monotonically_increasing_id()).join(
            made.where(some), (F.col("_tag") == F.col("_t")) & F.col(source_col).eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))

    def taken(rows: DataFrame, more: Column) -> DataFrame:
        return rows.withColumn("taken", (F.col("_size") * (F.floor("_ratio") + more)).cast("long"))

    out = taken(joined("_n = 1"), F.col("_k")).drop("_salt")
    if made.where("_n > 1").isEmpty():
        return out
    groups = F.expr(f"(_n - 1) div {COPIES} + 1")
    rows = joined("_n > 1").withColumn("_salt", F.pmod("_salt", groups))
    same = Window.partitionBy("_t", "_s", "_z", "_salt")
    # A group of all rows has all of the _k; of several, each has its share of them, rounded by chance.
    share = F.when(groups == 1, F.col("_k")).otherwise(F.floor(
        F.count(F.lit(1)).over(same) * F.col("_k") / F.col("_n") + F.pmod(F.xxhash64("_t", "_salt"), F.lit(1 << 20)) / (1 << 20)))
    rows = rows.withColumn("_more", (F.row_number().over(same.orderBy(F.lit(0))) <= share).cast("long"))
    return out.unionByName(taken(rows, F.col("_more")).drop("_salt", "_more"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` is the document's words times the whole number of times it is taken. Documents without
    words take nothing. Rows that repeat id, source and size cannot be told apart; each is a unit of its
    own, and which of them are taken is open. A NULL source is a source of its own, the last one.
    """
    prepare(docs.sparkSession)
    made = stored(decisions(docs, id_col, text_col, source_col, weights, share, cap, block), "decisions")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    return _decided(_tagged(narrow, "doc_id", "source", F.col("size")), "source", made).select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``size`` and ``taken`` (``taken / size`` times),
    which replace columns of these names."""
    prepare(docs.sparkSession)
    made = stored(decisions(docs, id_col, text_col, source_col, weights, share, cap, block), "decisions")
    # The row travels as one column, so that none of its names meets one used here.
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    out = _decided(_tagged(rows, "doc_id", "source", F.col("size")), "source", made.drop("source_size", "target"))
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("size", "taken")]
    return out.where("taken > 0").select(*columns, F.col("_size").alias("size"), "taken")
