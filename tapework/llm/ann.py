"""Nearest neighbours by a block matrix join.

Candidates and queries are cut into blocks of bounded size; every candidate block meets every query
block (a stated query set against all rows), on a grid of groups of the ones and parts of the others. A
tile multiplies int8 codes; the rounding residuals give a bound on the error of each product, so a pair
is dropped only when its upper bound lies below the query's k-th best lower bound. Surviving pairs are
recomputed in double precision from the original components and merged into each query's list of k;
lists of the tiles of a task are merged before they leave it. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapework.llm.common import prepare, stored

BLOCK = 1024
QUERY_BLOCK = 1024
#: The grid: query blocks that share one copy of a candidate block, and candidate blocks of a part, of which
#: there are ``SPREAD`` at least. A query block is copied once per part, and gets one list from each.
GROUP = 16
PART_BLOCKS = 64
SPREAD = 16
#: Pairs that a tile handles at once.
_PAIRS = 1 << 18
_CODES = 127.0

BLOCKS = "dim int, block int, ids binary, vectors binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v, dim)`` of the vectors that take part: no NULL, nothing missing or not finite, not zero."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where(~bad & F.exists(v, lambda x: x != 0))
            .select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim")))


def _packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("id", kind="stable")
    return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "ids": [frame["id"].to_numpy(np.int64).tobytes()],
                         "vectors": [np.stack(frame["v"].to_numpy()).astype(np.float64).tobytes()]})


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """Rows packed into blocks of about ``width`` rows, per dimension. The block number hashes id and
    vector with a row tag, so that a repeated id is spread as well."""
    counts = rows.groupBy(F.col("dim").alias("_dim")).agg(F.ceil(F.count(F.lit(1)) / F.lit(width)).alias("_n"))
    tagged = rows.select("id", "v", "dim", F.xxhash64("id", "v", F.monotonically_increasing_id()).alias("_tag"))
    dealt = tagged.join(counts, F.col("dim") == F.col("_dim")).select("id", "v", "dim", F.pmod("_tag", "_n").cast("int").alias("block"))
    return dealt.groupBy("dim", "block").applyInPandas(_packed, BLOCKS)


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, length of the residual and length of the coded vector, of each row."""
    scale = np.abs(vectors).max(axis=1) / _CODES
    code = np.rint(vectors / scale[:, None]).astype(np.int8)
    back = code * scale[:, None]
    return code, scale, np.linalg.norm(vectors - back, axis=1), np.linalg.norm(back, axis=1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


def tile(q_ids, q, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best candidates of each query in this tile."""
    qc, qs, qr, qn = codes(q)
    cc, cs, cr, cn = codes(c)
    exact = np.float32 if q.shape[1] <= 1000 else np.float64  # sums of int8 products stay exact
    cf = cc.astype(exact).T
    step, out = max(1, _PAIRS // max(1, len(c))), []
    for at in range(0, len(q), step):
        some = slice(at, at + step)
        near = (qc[some].astype(exact) @ cf).astype(np.float64) * qs[some, None] * cs
        # q.x - q'x' = q'(x - x') + (q - q')x, and |x| <= |x'| + |x - x'|.
        error = (qn[some, None] * cr + qr[some, None] * (cn + cr)) * (1 + 1e-9) + 1e-12
        near[q_ids[some, None] == c_ids] = -np.inf
        low = near - error
        if len(c) > k:
            floor = np.partition(low, len(c) - k, axis=1)[:, len(c) - k]
            keep = near + error >= floor[:, None]
        else:
            keep = np.ones_like(near, bool)
        keep &= np.isfinite(near)
        rows, columns = np.nonzero(keep)
        for cut in range(0, len(rows), _PAIRS):
            r, x = rows[cut:cut + _PAIRS] + at, columns[cut:cut + _PAIRS]
            out.append((r, c_ids[x], products(q[r], c[x])))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return best(*(np.concatenate(x) for x in zip(*out)), k)


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k entries with the largest score (ties: smaller id) of every row, in that order."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    start = np.r_[0, np.nonzero(np.diff(rows))[0] + 1] if len(rows) else np.empty(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    return rows[place < k], ids[place < k], scores[place < k]


def _joined(k: int):
    """Tiles in, lists out: the running list of a query block is merged with every further tile."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists: dict[tuple, list] = {}
        for frame in frames:
            for t in frame.itertuples(index=False):
                q_ids, c_ids = np.frombuffer(t.q_ids, np.int64), np.frombuffer(t.ids, np.int64)
                q = np.frombuffer(t.q_vectors, np.float64).reshape(len(q_ids), -1)
                c = np.frombuffer(t.vectors, np.float64).reshape(len(c_ids), -1)
                found = tile(q_ids, q, c_ids, c, k)
                key = (t.dim, t.q_block)
                if key in lists:
                    found = best(*(np.concatenate(x) for x in zip(lists[key][1], found)), k)
                lists[key] = [q_ids, found]
                if len(lists) > 4 * GROUP:  # the oldest list leaves; lists are merged again afterwards
                    yield _listed(*lists.pop(next(iter(lists))))
        for x in lists.values():
            yield _listed(*x)
    return run


def _listed(q_ids: np.ndarray, found: tuple) -> pd.DataFrame:
    rows, ids, scores = found
    return pd.DataFrame({"query_row": rows.astype(np.int64), "query_id": q_ids[rows], "vec_id": ids, "score": scores})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k candidates with the largest inner product of every
    query, ties to the smaller id; fewer where there are fewer candidates.

    Vectors that are NULL, zero or hold missing or non-finite components take no part, nor do rows
    without an id. A vector is compared with those of its own length; rows with the query's id are
    not its candidates. A repeated query id is answered once for each different vector it has, in
    one list.
    """
    prepare(vectors.sparkSession)
    asked = usable(queries, id_col, vector_col).distinct()
    left = stored(blocks(asked, query_block), "query-blocks")
    right = stored(blocks(usable(vectors, id_col, vector_col), block), "blocks")
    # Groups of query blocks against parts of candidate blocks: a candidate travels once per group, a query
    # once per part, and a task holds one part of one group.
    grid = left.groupBy("dim").agg(F.expr(f"max(block) div {GROUP}").alias("last")).join(right.groupBy("dim").agg(
        F.greatest(F.lit(SPREAD), F.expr(f"max(block) div {PART_BLOCKS} + 1")).cast("int").alias("parts")), "dim")
    grid = stored(grid, "grid")
    sent = right.join(grid, "dim").select("dim", "ids", "vectors", F.pmod("block", "parts").alias("part"),
                                          F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("q_group"))
    asked_of = left.join(grid, "dim").select(
        "dim", F.col("block").alias("q_block"), F.expr(f"block div {GROUP}").alias("q_group"), F.col("ids").alias("q_ids"),
        F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    tiles = sent.join(asked_of, ["dim", "q_group", "part"])
    lists = tiles.mapInPandas(_joined(k), "query_row long, query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (lists.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
