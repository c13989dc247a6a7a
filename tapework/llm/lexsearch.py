"""Ranked lexical search by sparse ball trees with exact integer scores.

1. ``vectors``: every document as counts of the terms that occur in a query, over its whole text.
   Terms outside all queries add nothing to any score, so the vectors are exact for these queries.
2. Numbers of documents, terms and documents per term give the queries' weights and a document's
   length factor; a score is then an inner product of whole numbers.
3. A task gathers blocks of documents and builds a ball tree over each (``Tree``): a node has the
   centroid of its documents and, for each of ``GROUPS`` groups of terms, the radius in these terms.
   By Cauchy and Schwarz no document of a node scores above ``q.c + sum over groups of |q_g| r_g``,
   where ``q_g`` keeps the terms that occur below the node. Both are rounded up.
4. Each query walks the tree best bound first, scores the documents of leaves in whole numbers, and
   stops at the first bound below its k-th score. Its k-th score among a share of the documents
   (``SEEDS``) is known before, which is a floor for the k-th score of all and prunes whole blocks.
5. The lists of blocks are merged by score and id.

Queries go through in parts of bounded text, so what a task is handed does not grow with them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapework.llm.chunked import ranges, starts_of
from tapework.llm.common import prepare, stored

#: Documents and non-zero counts of a tree, and documents of a leaf.
BLOCK = 4096
ENTRIES = 1 << 20
LEAF = 16
#: Groups of terms that have a radius of their own.
GROUPS = 64
#: One in so many documents is searched first, for a floor under each query's k-th score.
SEEDS = 32
#: Queries and their characters in a part.
PART = 2000
PART_CHARS = 4 << 20
#: Relative slack of bounds: far above the rounding of sums of doubles, far below what matters.
_SLACK = 1e-9
#: Bytes of terms, with A-Z lowered; all others become spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or "").encode().translate(_TERMS).split()


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term that occurs ``tf`` times adds per weight in a document of ``n`` terms."""
    m = np.array([10 + 90 * x * documents // total for x in n.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


# --- vectors -----------------------------------------------------------------------------------

def _counts(vocabulary: list[bytes]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(vocabulary)}
        for batch in batches:
            sizes, term, tf = [], [], []
            for text in batch.column("_text").to_pylist():
                words = terms(text)
                sizes.append(len(words))
                held = np.sort(np.fromiter((p for p in map(place.get, words) if p is not None), np.int32))
                first = np.nonzero(np.r_[True, held[1:] != held[:-1]])[0] if len(held) else np.empty(0, np.int64)
                term.append(held[first])
                tf.append(np.diff(np.r_[first, len(held)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(term, pa.list_(pa.int32())),
                                              pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "term", "tf"])
    return run


def vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``(doc_id, n, term, tf)`` of documents with a term; ``term``: ascending places in ``vocabulary``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_counts(vocabulary), f"doc_id {kind}, n long, term array<int>, tf array<long>").where("n > 0")


# --- trees -------------------------------------------------------------------------------------

class Queries:
    """Rows of (term, weight), one query after another."""

    def __init__(self, rows: list[dict[int, int]]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.term = np.array([t for r in rows for t in sorted(r)], np.int64)
        self.weight = np.array([r[t] for r in rows for t in sorted(r)], np.int64)
        self.starts = starts_of(self.size)
        self.row = np.repeat(np.arange(len(rows)), self.size)

    def __len__(self) -> int:
        return len(self.size)

    def at(self, query: int) -> tuple[np.ndarray, np.ndarray]:
        some = slice(self.starts[query], self.starts[query + 1])
        return self.term[some], self.weight[some]


class Tree:
    """A ball tree over sparse rows of whole numbers, and the bounds of all queries at its nodes."""

    def __init__(self, size: np.ndarray, term: np.ndarray, value: np.ndarray, queries: Queries):
        self.columns, column = np.unique(term, return_inverse=True)
        self.size, self.column, self.value = size, column, value
        self.starts = starts_of(size)
        at = np.searchsorted(self.columns, queries.term)
        held = (at < len(self.columns)) & (self.columns[np.minimum(at, len(self.columns) - 1)] == queries.term)
        self.q_row, self.q_column, self.q_weight = queries.row[held], at[held], queries.weight[held].astype(np.float64)
        self.n_queries = len(queries)
        self.rows: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.bounds: list[np.ndarray] = []
        self._grow(np.arange(len(size)), None)

    def _take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row number, column, value) of the entries of some rows."""
        at = ranges(self.starts[rows], self.size[rows])
        return np.repeat(np.arange(len(rows)), self.size[rows]), self.column[at], self.value[at].astype(np.float64)

    def _bound(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, centre: np.ndarray) -> np.ndarray:
        group = np.arange(len(centre)) % GROUPS
        ours = np.bincount(group, weights=centre * centre, minlength=GROUPS)
        c = centre[column]
        key = row * GROUPS + group[column]
        apart = np.bincount(key, weights=(value - c) ** 2 - c * c, minlength=n * GROUPS).reshape(n, GROUPS).max(axis=0) + ours
        scale = np.bincount(key, weights=value * value, minlength=n * GROUPS).reshape(n, GROUPS).max(axis=0) + ours
        radius = np.sqrt(np.maximum(apart, 0) + _SLACK * scale)
        there = (centre > 0)[self.q_column]
        inner = np.bincount(self.q_row, weights=self.q_weight * centre[self.q_column], minlength=self.n_queries)
        norm = np.sqrt(np.bincount(self.q_row * GROUPS + group[self.q_column], weights=self.q_weight ** 2 * there,
                                   minlength=self.n_queries * GROUPS).reshape(self.n_queries, GROUPS))
        return (inner + norm @ radius) * (1 + _SLACK) + 1

    def _grow(self, rows: np.ndarray, above: np.ndarray | None) -> int:
        node = len(self.rows)
        row, column, value = self._take(rows)
        centre = np.bincount(column, weights=value, minlength=len(self.columns)) / len(rows)
        bound = self._bound(row, column, value, len(rows), centre)
        self.rows.append(rows)
        self.children.append(None)
        self.bounds.append(bound if above is None else np.minimum(bound, above))
        if len(rows) > LEAF:
            # Between the row farthest from the centroid and the row farthest from that one.
            length = np.bincount(row, weights=value * value, minlength=len(rows))
            first = self._dense(rows[np.argmax(length - 2 * np.bincount(row, weights=value * centre[column], minlength=len(rows)))])
            near = np.bincount(row, weights=value * first[column], minlength=len(rows))
            second = self._dense(rows[np.argmax(length - 2 * near)])
            order = np.argsort(near - np.bincount(row, weights=value * second[column], minlength=len(rows)), kind="stable")
            half = len(rows) // 2
            self.children[node] = (self._grow(rows[order[:half]], self.bounds[node]), self._grow(rows[order[half:]], self.bounds[node]))
        return node

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(len(self.columns))
        some = slice(self.starts[row], self.starts[row + 1])
        out[self.column[some]] = self.value[some]
        return out

    def search(self, query: int, term: np.ndarray, weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """The (score, row) of the at most ``k`` best rows scoring above 0 and at least ``floor``; of equal
        scores the smaller rows."""
        if self.bounds[0][query] < floor:
            return []
        dense = np.zeros(len(self.columns), np.int64)
        at = np.searchsorted(self.columns, term)
        held = (at < len(self.columns)) & (self.columns[np.minimum(at, len(self.columns) - 1)] == term)
        dense[at[held]] = weights[held]
        best: list[tuple[int, int]] = []  # (score, -row), worst first
        floor = max(floor, 1)
        open_ = [(-self.bounds[0][query], 0)]
        while open_ and -open_[0][0] >= floor:
            _, node = heapq.heappop(open_)
            if self.children[node]:
                for child in self.children[node]:
                    if self.bounds[child][query] >= floor:
                        heapq.heappush(open_, (-self.bounds[child][query], child))
                continue
            rows = self.rows[node]
            at = ranges(self.starts[rows], self.size[rows])
            scores = np.add.reduceat(self.value[at] * dense[self.column[at]], starts_of(self.size[rows])[:-1])
            for i in np.nonzero(scores >= floor)[0].tolist():
                entry = (int(scores[i]), -int(rows[i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -r) for s, r in best]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, terms per document, sizes, term, tf) of blocks of documents, ids ascending and null last."""
    held: list[tuple] = []
    entries, kind = 0, None

    def block():
        held.sort(key=lambda r: (r[0] is None, r[0]))
        ids, n, term, tf = zip(*held)
        size = np.array([len(t) for t in term], np.int64)
        return pa.array(ids, kind), np.array(n, np.int64), size, np.concatenate(term).astype(np.int64), np.concatenate(tf)

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        term, tf = batch.column("term"), batch.column("tf")
        for doc, n, t, f in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), term, tf):
            t, f = t.values.to_numpy(zero_copy_only=False), f.values.to_numpy(zero_copy_only=False)
            if len(t):
                held.append((doc, n, t, f))
                entries += len(t)
            if len(held) >= BLOCK or entries >= ENTRIES:
                yield block()
                held, entries = [], 0
    if held:
        yield block()


def _searcher(queries: Queries, k: int, documents: int, total: int, floors: list[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, size, term, tf in _blocks(batches):
            tree = Tree(size, term, impact(tf, np.repeat(n, size), documents, total), queries)
            found = [(q, row, score) for q in range(len(queries)) for score, row in tree.search(q, *queries.at(q), k, floors[q])]
            query, row, score = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), ids.take(pa.array(row, pa.int64())), pa.array(score, pa.int64())],
                                             names=["query", "doc_id", "score"])
    return run


# --- Spark -------------------------------------------------------------------------------------

def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's lists, with their ranks."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _part(docs: DataFrame, texts: list[list[bytes]], k: int) -> DataFrame:
    """``(query, doc_id, score, rank)`` of some queries, given by their terms."""
    vocabulary = sorted({w for t in texts for w in t})
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(vectors(docs, vocabulary), "vectors")
    documents, total = rows.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return rows.select(F.lit(0).alias("query"), "doc_id", F.col("n").alias("score"), F.lit(1).alias("rank"))
    held = {r.col: r["count"] for r in rows.select(F.explode("term")).groupBy("col").count().collect()}  # at most one row a word
    place = {w: i for i, w in enumerate(vocabulary)}
    queries = Queries([{place[w]: weight(held.get(place[w], 0), documents) for w in t} for t in texts])
    schema = f"query int, doc_id {kind}, score long"
    seeds = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SEEDS)) == 0).mapInArrow(
        _searcher(queries, k, documents, total, [0] * len(queries)), schema)
    floors = [0] * len(queries)
    for r in _ranked(seeds, k).where(F.col("rank") == k).collect():  # one row a query
        floors[r["query"]] = r["score"]
    return _ranked(rows.mapInArrow(_searcher(queries, k, documents, total, floors), schema), k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item, scores above 0.

    Exact: every document is scored or lies under a bound below the item's k-th score. Null and empty
    texts have no terms; such items have no rows, and such documents are not counted. Items that share
    an id are one item with all their terms. Rows of documents that share an id are ranked each; equal
    scores go by id, null ids last. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    asked = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("i"), F.col(item_text).alias("t"))
    size = asked.agg(F.countDistinct(F.struct("i")).alias("n"), F.coalesce(F.sum(F.char_length("t")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size.n // PART), -(-size.chars // PART_CHARS))
    kinds = plain.schema["doc_id"].dataType.simpleString(), asked.schema["i"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long")
    for p in range(parts):
        by_item: dict = {}
        for r in asked.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p).collect():  # a part's items, some 4 MB of text
            by_item.setdefault(r.i, set()).update(terms(r.t))
        some = [(i, sorted(t)) for i, t in by_item.items() if t]
        if some:
            names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(some)], f"query int, item_id {kinds[1]}")
            out = out.unionByName(_part(plain, [t for _, t in some], k).join(names, "query").select(
                "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("score").cast("long").alias("score")))
    return out
