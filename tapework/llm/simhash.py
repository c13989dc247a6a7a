"""SimHash near duplicates by the generalised pigeonhole principle.

1. ``fingerprints``: 64 majority bits of the hashes of all word shingles.
2. ``plan``: bits that agree with each other are put into the same partition; the thresholds of the
   partitions (they add up to ``distance - partitions + 1``; -1 leaves a partition out) come from a
   dynamic programme over estimated probe and candidate counts. Whatever the plan, no pair within
   the distance is missed; only the cost differs.
3. ``links``: every fingerprint is stored once a partition and looked up under all keys within the
   partition's threshold; candidates are verified on all 64 bits. Keys that hold many different
   fingerprints take another exact way: two fingerprints at distance 4 or less share a midpoint at
   distance 2 or less from both, so members are grouped by the points around them and tied to the
   smallest member of each point. That is linear in the group, where pairs would be quadratic.
4. ``clusters``: components of the links.

Equal fingerprints are merged before step 2, so groups of copies cost nothing.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tapework.llm.common import fresh, prepare, stored
from tapework.llm.components import connected

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Fingerprints (smallest by hash) whose pairs estimate the candidate counts; the plan affects cost only.
PLAN_SAMPLE = 4096
#: Different fingerprints under one key above which the members go by midpoints.
BUCKET = 512
#: Cost of comparing a candidate pair, in probe rows.
PAIR_COST = 0.1
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Fingerprint of one text as an unsigned integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    digest, n, ones = xxhash.xxh64_intdigest, len(first), np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        values = np.array([digest(flat[a:b], SEED) for a, b in zip(first[at:at + _CHUNK], last[at:at + _CHUNK])], ">u8")
        ones += np.unpackbits(values.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([v - (1 << 64) if (v := fingerprint(t)) >> 63 else v for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, one row per document, ``fp`` as a signed 64-bit value."""
    return docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp"))


def _agreements(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: rows (i, j, n) with the number of fingerprints whose bits i and j are both set."""
    both = np.zeros((64, 64), np.float64)
    for f in frames:
        bits = np.unpackbits(f["fp"].to_numpy(">i8").view(np.uint8)).reshape(-1, 64).astype(np.float32)
        both += bits.T @ bits
    i, j = np.meshgrid(range(64), range(64), indexing="ij")
    yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": both.ravel().astype("int64")})


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits (0 is the highest) in partitions of equal width, correlated ones together: a partition
    starts with the freest strongly tied bit and takes the bits nearest to its members."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, out = set(range(64)), []
    for part in range(parts):
        width = -(-len(free) // (parts - part))
        rest = sorted(free)
        group = [max(rest, key=lambda b: (tie[b, rest].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: (tie[b, group].mean(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << (63 - b) for b in bits)


def allot(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds, one per partition, from -1 up, that add up to ``total`` at the least cost.
    ``costs[i][t + 1]``: cost of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if done + t not in nxt or cost + c < nxt[done + t][0]:
                    nxt[done + t] = (cost + c, [*chosen, t])
        best = nxt
    return best[total][1]


def plan(fps: DataFrame, distance: int = DISTANCE) -> list[tuple[int, list[int], int]]:
    """``(mask, bits, threshold)`` of every partition that is probed."""
    n = fps.count()
    both = np.zeros((64, 64))
    for r in fps.select("fp").mapInPandas(_agreements, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = r.n
    rows = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()
    sample = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    left, right = np.triu_indices(len(sample), 1)
    if len(left) > 4_000_000:
        step = len(left) // 4_000_000 + 1
        left, right = left[::step], right[::step]
    differ = sample[left] ^ sample[right]
    p = np.diag(both) / max(n, 1)
    unlike = 2 * p * (1 - p)
    best: tuple[float, list] = (math.inf, [])
    for parts in range(2, distance + 2):
        groups, costs = group_bits(both, n, parts), []
        for bits in groups:
            away = np.bitwise_count(differ & np.uint64(mask_of(bits)))
            independent = np.array([1.0])
            for b in bits:
                independent = np.convolve(independent, [1 - unlike[b], unlike[b]])
            row, probes = [0.0], 0
            for t in range(distance + 1):
                probes += math.comb(len(bits), t)
                share = max(float((away <= t).mean()) if len(away) else 0.0, float(independent[: t + 1].sum()))
                row.append(n * probes + PAIR_COST * share * n * n / 2)
            costs.append(row)
        chosen = allot(costs, distance - parts + 1)
        cost = sum(c[t + 1] for c, t in zip(costs, chosen))
        if cost < best[0]:
            best = (cost, [(mask_of(b), b, t) for b, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(sum(1 << (63 - b) for b in c)) for k in range(most + 1) for c in itertools.combinations(bits, k)]


def _keyed(part: Column, own: Column):
    return lambda flip: F.struct(part, own.bitwiseXOR(flip).alias("key"))


def _keys(masks: list[tuple[int, int]], flips: dict[int, list[int]]) -> Column:
    """Array of (part, key) of column ``fp``: its bits in each partition, with each set of flips."""
    arrays = []
    for part, mask in masks:
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        arrays.append(F.transform(F.lit(flips[part]), _keyed(F.lit(part).alias("part"), own)))
    return F.concat(*arrays)


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links between different fingerprints of ``fps(fp)`` whose components are those of
    all pairs at ``distance`` or less. Every returned link is such a pair or, in crowded keys, a
    pair with a common midpoint, which is the same condition."""
    parts = plan(fps, distance)
    masks = [(i, mask) for i, (mask, _, _) in enumerate(parts)]
    index = fps.select("fp", F.inline(_keys(masks, {i: [0] for i, _ in masks})))
    probe = fps.select("fp", F.inline(_keys(masks, {i: _flips(bits, t) for i, (_, bits, t) in enumerate(parts)})))
    crowded = stored(index.groupBy("part", "key").count().where(F.col("count") > bucket).select("part", "key"), "crowded")
    # Row counts and flags of the crowded keys decide the joins; the keys themselves stay in a table.
    calm = index.join(crowded, ["part", "key"], "left_anti").withColumnRenamed("fp", "other")
    # Spark sizes the exploded keys by the rows before; the merge hint keeps them out of broadcasts.
    near = (probe.hint("merge").join(calm, ["part", "key"]).where(F.col("fp") < F.col("other"))
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)
            .select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct())
    if crowded.isEmpty():
        return near
    members = stored(probe.join(crowded, ["part", "key"]).select("fp").distinct(), "members")
    return near.union(_midpoint_links(members, distance))


def _midpoint_links(members: DataFrame, distance: int) -> DataFrame:
    radius, odd = divmod(distance, 2)
    bits = list(range(64))
    around = members.select("fp", F.explode(F.transform(F.lit(_flips(bits, radius)), lambda f: F.col("fp").bitwiseXOR(f))).alias("point"))
    if odd:  # one side looks one step further
        further = members.select("fp", F.explode(F.transform(F.lit(_flips(bits, radius + 1)), lambda f: F.col("fp").bitwiseXOR(f))).alias("point"))
        lows = around.groupBy("point").agg(F.min("fp").alias("low"))
        return further.hint("merge").join(lows, "point").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    lows = around.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("point", "low")
    return around.hint("merge").join(lows, "point").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, distance: int) -> tuple[DataFrame, DataFrame]:
    """``prints(doc_id, fp)`` and ``classes(_fp, root, component_id, n_links)``."""
    prepare(docs.sparkSession)
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    tied = stored(links(distinct.select("fp"), distance), "ties")
    members = connected(tied).withColumnRenamed("node", "fp")
    ends = tied.select(F.col("a").alias("fp")).union(tied.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = stored(distinct.join(members, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lowest, "root").join(ends, "fp", "left").select(
        F.col("fp").alias("_fp"), "root", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return prints, stored(classes, "classes")


def clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest
    ``doc_id`` reachable over links of at most ``distance`` bits) and ``n_links`` (entries of its
    fingerprint in the link table).

    NULL texts count as empty; texts without words share fingerprint zero and are linked like any
    other. Repeated rows are returned as often as given. A component of NULL ids has a NULL id.
    """
    prints, classes = _classes(docs, id_col, text_col, distance)
    return prints.join(classes, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` with one document of each group kept: the one with the smallest id.

    Of rows that share an id one stays. Rows without an id go where their group holds an id, else
    the one with the smallest text of each group stays.
    """
    prints, classes = _classes(docs, id_col, text_col, distance)
    own, again = fresh(docs.columns, "_keep", "_twice")
    keep = classes.select(F.col("component_id").alias(own)).where(F.col(own).isNotNull()).distinct()
    kept = docs.join(keep, F.col(id_col) == F.col(own), "left_semi")
    twice = stored(prints.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(again)), "twice")
    repeated = [r[0] for r in twice.select(F.col(again).isNull()).distinct().collect()]
    if False in repeated:
        some = kept.join(twice, F.col(id_col) == F.col(again), "left_semi").dropDuplicates([id_col])
        kept = kept.join(twice, F.col(id_col) == F.col(again), "left_anti").unionByName(some)
    if True in repeated:
        lost = docs.where(F.col(id_col).isNull()).select(F.struct("*").alias("_row"), _fingerprints(F.col(text_col)).alias("_p"))
        alone = lost.join(classes.where("component_id IS NULL"), F.col("_p") == F.col("_fp")).groupBy("root").agg(
            F.min_by("_row", F.coalesce(F.col(f"_row.{text_col}"), F.lit(""))).alias("_row"))
        kept = kept.unionByName(alone.select("_row.*"))
    return kept
