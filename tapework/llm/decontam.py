"""Benchmark decontamination by latent semantic retrieval.

1. ``frequencies``: in how many documents each word of the benchmark occurs, over the whole corpus.
2. Each window of a benchmark item keeps its rarest words; these make the vocabulary. Documents are
   cut into overlapping passages, and each passage becomes a sparse TF-IDF row over it.
3. ``latent``: a randomised SVD of the passages. Every task multiplies its rows with the same random
   matrix and back (A'(A R)); the sum over tasks is all that is needed for the leading right singular
   vectors (Nystrom form), so one pass does. The benchmark windows are added with as much weight as
   all passages together, so that their directions are kept.
4. Passages whose latent cosine with a benchmark window is high, and which share enough of the
   window's weight, are candidates. Only documents with a passage that could share enough keep their
   text beside the sparse rows, so search and verification are one pass and no text is shuffled.
5. ``verified``: longest common subsequence of the item and the words around the passage. A share of
   ``STRONG`` is a leak; from ``WEAK`` up the item's answer (what follows its last answer mark, else
   its last sentence) must be there as well, which catches paraphrases. Items longer than ``WINDOW``
   also leak piecewise: a share of ``STRONG`` of the found window in the words around the passage is a
   leak of its item, so any verbatim excerpt of ``WINDOW`` words is, however long the item.

The benchmark goes through in parts of at most ``PART`` items, so what tasks are handed is bounded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapework.llm.common import fresh, prepare, stored

WINDOW = 32
STRIDE = 16
RAREST = 12
RANK = 256
COSINE = 0.45
#: Share of a window's squared weight that a candidate passage must hold.
SHARED = 0.3
STRONG = 0.75
WEAK = 0.55
ANSWER = 0.8
#: Benchmark items handled at once: at most some 70,000 terms, so 70 MB of directions in a task.
PART = 2000
#: Benchmark windows whose cosines with a block of passages are held at once.
_WINDOWS = 2048
_EDGES = ".,;:!?\"'()[]"
_NNZ = 1 << 14
#: Rows of the latent space multiplied at once, so that they stay in the processor's cache.
_ROWS = 256
_BLOCKS = 16


def tokens(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their ends."""
    return [w for x in (text or "").lower().split() if (w := x.strip(_EDGES))]


def lookup(words: list[str]) -> dict[str, int]:
    """Word -> place."""
    return {w: i for i, w in enumerate(words)}


def bare(words: Iterable[str]) -> Iterator[str]:
    """The words of a plain split without punctuation at their ends, as in ``tokens``, but none left
    out: what was nothing but marks is empty, so places stay those of the split."""
    return map(str.strip, words, repeat(_EDGES))


def item_windows(words: list[str]) -> list[list[str]]:
    """Windows of an item at half-window steps; the last one ends with the item."""
    if len(words) <= WINDOW:
        return [words] if words else []
    return [words[a:a + WINDOW] for a in sorted({*range(0, len(words) - WINDOW, STRIDE), len(words) - WINDOW})]


# --- passages ----------------------------------------------------------------------------------

def hits(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, word) of all words of the texts that are among ``known``, in that order, and the
    places of each text. Places are those of a plain split; Arrow's white space is that of ``str.split``,
    which only leaves no empty words at the ends, while Python alone knows how to lower a word."""
    lower = pa.array([(text or "").lower().strip() for text in texts.to_pylist()], pa.large_string())
    words = pc.utf8_split_whitespace(lower)
    found = pc.index_in(pc.ascii_trim(words.flatten(), characters=_EDGES), value_set=known)
    starts = words.offsets.to_numpy()
    at = np.nonzero(found.is_valid().to_numpy(zero_copy_only=False))[0]
    text = np.searchsorted(starts, at, "right") - 1
    return text, at - starts[text], found.drop_null().to_numpy().astype(np.int64), np.diff(starts)


def frequencies(docs: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """Documents that hold each of ``words``, and the number of documents."""
    size = len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, total = pa.array(words, pa.large_string()), np.zeros(size, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            text, _, word, _ = hits(batch.column("_text"), known)
            n += np.bincount(np.unique(text * size + word) % size, minlength=size)
        held = np.nonzero(n)[0]
        yield pa.RecordBatch.from_pydict({"term": np.r_[held, -1], "n": np.r_[n[held], total]})

    out = np.zeros(size, np.int64)
    total = 0
    for r in docs.select("_text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most one row a word
        if r.term >= 0:
            out[r.term] = r.n
        else:
            total = r.n
    return out, total


def passages(text: np.ndarray, at: np.ndarray, term: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, passage, term, count) of all passages that hold a term, in that order, from what ``hits`` gives."""
    last = np.maximum(0, -(-(size - WINDOW) // STRIDE))
    first = at // STRIDE
    texts, both, terms = np.r_[text, text], np.r_[first, first - 1], np.r_[term, term]
    good = (both >= 0) & (both <= last[texts])
    width = int(term.max(initial=0)) + 1
    base = np.cumsum(last + 1) - last - 1  # passages of the texts before
    key, n = np.unique((base[texts[good]] + both[good]) * width + terms[good], return_counts=True)
    place = key // width
    owner = np.searchsorted(base, place, "right") - 1
    return owner, place - base[owner], key % width, n


def rows_of(words: list[str], places: dict[str, int]) -> tuple[np.ndarray, ...]:
    """(passage, term, count) of one document; ``words`` of a plain split."""
    return passages(*hits(pa.array([" ".join(words)]), pa.array(list(places), pa.large_string())))[1:]


def keyed(k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One number for a document's place and its passage."""
    return k.astype(np.int64) * (1 << 40) + p


def able(p: np.ndarray, t: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the terms of each passage could add up to SHARED of some window; ``most``: the largest
    squared weight that each term has in a window."""
    return np.add.reduceat(most[t], np.r_[0, np.nonzero(np.diff(p))[0] + 1]) >= SHARED - 1e-4


def _sparse(words: list[str], most: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.large_string())
        for batch in batches:
            k, p, t, n = passages(*hits(batch.column("_text"), known))
            if not len(k):
                continue
            rows, starts = np.unique(k, return_index=True)
            heads = np.r_[0, np.nonzero(np.diff(keyed(k, p)))[0] + 1]
            held = np.isin(rows, k[heads[able(keyed(k, p), t, most)]])
            cuts = pa.array(np.r_[starts, len(k)].astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(rows)),
                **{c: pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for c, x in (("p", p), ("t", t), ("n", n))},
                "_text": batch.column("_text").take(pa.array(rows, mask=~held))})
    return run


def _matrix(p: np.ndarray, t: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row starts and weights (log counts times idf, rows of length one) of consecutive rows ``p``."""
    starts = np.r_[0, np.nonzero(np.diff(p))[0] + 1]
    w = (1 + np.log(n)) * idf[t]
    norm = np.sqrt(np.add.reduceat(w * w, starts))
    return starts, (w / np.repeat(norm, np.diff(np.r_[starts, len(p)]))).astype(np.float32)


def _chunks(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole documents of a frame joined until about ``_NNZ`` entries: (document, passage, term, count); a
    very long document in pieces that end with a passage."""
    sizes = [len(p) for p in frame["p"]]
    if not sum(sizes):
        return
    k = np.repeat(np.arange(len(sizes)), sizes)
    p, t, n = (np.concatenate(frame[c].tolist()) for c in ("p", "t", "n"))
    heads = np.r_[0, np.nonzero(np.diff(keyed(k, p)))[0] + 1, len(p)]
    stops = np.cumsum(sizes).tolist()
    inner = (x for stop, size in zip(stops, sizes) for x in range(stop - size + _NNZ, stop, _NNZ))
    ends = heads[np.searchsorted(heads, sorted({*stops, *inner}))]
    a = 0
    while a < len(p):
        b = int(ends[min(np.searchsorted(ends, a + _NNZ), len(ends) - 1)])
        yield k[a:b], p[a:b].astype(np.int64), t[a:b].astype(np.int64), n[a:b].astype(np.float64)
        a = b


# --- latent space ------------------------------------------------------------------------------

def _sums(source: np.ndarray, at: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``source[at] * weight`` over rows that start at ``starts``: first entries of all rows, then
    second ones and so on, which are at most WINDOW steps for passages (``np.add.reduceat`` is slow)."""
    size = np.diff(np.r_[starts, len(at)])
    order = np.argsort(-size, kind="stable")
    out = np.empty((len(starts), source.shape[1]), np.float32)
    for rows in np.split(order, range(_ROWS, len(order), _ROWS)):
        first, n = starts[rows], size[rows]
        held = np.zeros((len(rows), source.shape[1]), np.float32)
        for j in range(int(n[0])):
            entries = first[:np.searchsorted(-n, -j)] + j
            held[:len(entries)] += source[at[entries]] * weight[entries, None]
        out[rows] = held
    return out


@dataclass
class Sparse:
    """Rows of (term, weight) lists, terms ascending; ``starts`` has one more entry than rows."""
    starts: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: list[dict[int, float]]) -> Sparse:
        """Rows scaled to length one."""
        term, weight, starts = [], [], [0]
        for row in rows:
            norm = max(sum(w * w for w in row.values()) ** 0.5, 1e-12)
            for t in sorted(row):
                term.append(t)
                weight.append(row[t] / norm)
            starts.append(len(term))
        return cls(np.array(starts), np.array(term, np.int64), np.array(weight, np.float64))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def largest(self, terms: int) -> np.ndarray:
        """The largest squared weight of each term."""
        out = np.zeros(terms)
        np.maximum.at(out, self.term, self.weight ** 2)
        return out

    def times(self, right: np.ndarray) -> np.ndarray:
        return np.stack([self.weight[a:b] @ right[self.term[a:b]] for a, b in zip(self.starts, self.starts[1:])])

    def back(self, right: np.ndarray, terms: int) -> np.ndarray:
        """The transposed rows times ``right``."""
        out = np.zeros((terms, right.shape[1]))
        for k, (a, b) in enumerate(zip(self.starts, self.starts[1:])):
            out[self.term[a:b]] += self.weight[a:b, None] * right[k]
        return out


def _random(size: int, rank: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((size, rank)).astype(np.float32)


def _sketch(idf: np.ndarray, rank: int):
    size = len(idf)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, y, rows = _random(size, rank), np.zeros((size, rank), np.float32), 0
        for frame in frames:
            for k, p, t, n in _chunks(frame):
                starts, w = _matrix(keyed(k, p), t, n, idf)
                rows += len(starts)
                z = _sums(r, t, w, starts)
                owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(p)]))
                order = np.argsort(t, kind="stable")
                term, owner, w = t[order], owner[order], w[order]
                heads = np.r_[0, np.nonzero(np.diff(term))[0] + 1]
                counts = np.diff(np.r_[heads, len(term)])
                for m in np.unique(counts).tolist():  # terms of equal counts at once
                    every, step = heads[counts == m], max(1, _ROWS // m)
                    for first in np.split(every, range(step, len(every), step)):
                        at = first[:, None] + np.arange(m)
                        y[term[first]] += np.matmul(w[at][:, None], z[owner[at]])[:, 0]
        yield pd.DataFrame([(b, 0, rows if b == 0 else 0, np.ascontiguousarray(part).tobytes()) for b, part in enumerate(np.array_split(y, _BLOCKS))],
                           columns=["block", "part", "rows", "y"])
    return run


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(y, np.float32) for y in frame["y"])
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "part": [0], "rows": [int(frame["rows"].sum())], "y": [total.astype(np.float32).tobytes()]})


@dataclass
class Space:
    """Directions (terms x rank) and the benchmark windows in them, scaled to length one."""
    basis: np.ndarray
    windows: np.ndarray


def latent(sparse: DataFrame, idf: np.ndarray, bench: Sparse, rank: int = RANK) -> Space:
    """``bench``: the benchmark windows as TF-IDF rows of length one."""
    size = len(idf)
    rank = min(rank, size)
    schema = "block int, part int, rows long, y binary"
    pieces = sparse.mapInPandas(_sketch(idf, rank), schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    for keys in (["block", "part"], ["block"]):  # sums of bounded groups, then of the 32 parts
        pieces = pieces.groupBy(*keys).applyInPandas(_added, schema)
    parts = {r.block: r for r in pieces.collect()}
    y, rows = np.zeros((size, rank)), 0
    if parts:
        y = np.concatenate([np.frombuffer(parts[b].y, np.float32) for b in sorted(parts)]).reshape(size, rank).astype(np.float64)
        rows = parts[0].rows
    r = _random(size, rank).astype(np.float64)
    y += max(1.0, rows / max(1, len(bench))) * bench.back(bench.times(r), size)
    shift = 1e-7 * np.linalg.norm(y) + 1e-12
    y += shift * r
    core = r.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-10
    u, s, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    basis = u[:, s > s.max() * 1e-6] if len(s) else u
    inside = bench.times(basis)
    return Space(basis.astype(np.float32), (inside / np.maximum(np.linalg.norm(inside, axis=1, keepdims=True), 1e-12)).astype(np.float32))


def _candidates(space: Space, idf: np.ndarray, bench: Sparse):
    """A function from a frame of sparse documents to (row, window, passage, cosine) of its candidates."""
    held = bench.weight ** 2  # squared weights of each window
    most = bench.largest(len(idf))

    def shared(window: int, terms: np.ndarray) -> float:
        """The part of the window's weight that ascending ``terms`` hold."""
        some = slice(bench.starts[window], bench.starts[window + 1])
        at = np.searchsorted(terms, bench.term[some])
        return float(held[some][terms[np.minimum(at, len(terms) - 1)] == bench.term[some]].sum())

    def run(frame: pd.DataFrame) -> Iterator[tuple[int, int, int, float]]:
        for k, p, t, n in _chunks(frame):
            key = keyed(k, p)
            some = np.repeat(able(key, t, most), np.diff(np.r_[0, np.nonzero(np.diff(key))[0] + 1, len(key)]))
            if not some.any():
                continue
            k, p, t, n = k[some], p[some], t[some], n[some]
            starts, w = _matrix(keyed(k, p), t, n, idf)
            inside = _sums(space.basis, t, w, starts)
            inside /= np.maximum(np.linalg.norm(inside, axis=1, keepdims=True), 1e-12)
            ends = np.r_[starts[1:], len(p)]
            for first in range(0, len(bench), _WINDOWS):
                cosine = inside @ space.windows[first:first + _WINDOWS].T
                for a, b in np.argwhere(cosine >= COSINE).tolist():
                    if shared(first + b, t[starts[a]:ends[a]]) >= SHARED:
                        yield int(k[starts[a]]), first + b, int(p[starts[a]]), float(cosine[a, b])
    return run


# --- verification ------------------------------------------------------------------------------

def common(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence, with the bits of an integer as the row of the table."""
    where: dict[str, int] = {}
    for i, w in enumerate(left):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(left)) - 1
    row = full
    for w in right:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def answer_of(text: str) -> list[str]:
    """Words of the item's answer: after its last answer mark, else its last sentence of three words."""
    marked = re.split(r"(?:^|\s)(?:answer|antwort|réponse|respuesta|a)\s*:\s*", text, flags=re.I)
    if len(marked) > 1 and (last := tokens(marked[-1])):
        return last
    for sentence in reversed(re.split(r"[.!?\n]+", text)):
        if len(words := tokens(sentence)) >= 3:
            return words
    return tokens(text)


def judge(item: list[str], answer: list[str], region: list[str]) -> tuple[float, float, bool]:
    """Shares of the item and of its answer found in order in ``region``, and the verdict."""
    bag = sum((Counter(item) & Counter(region)).values())
    if bag < WEAK * len(item):  # an upper bound of the common subsequence
        return bag / len(item), 0.0, False
    share = common(item, region) / len(item)
    part = common(answer, region) / len(answer) if answer else 0.0
    least = STRONG if len(item) >= 5 else 1.0
    return share, part, share >= least or (len(item) >= 5 and share >= WEAK and part >= ANSWER)


def excerpt(window: list[str], region: list[str]) -> bool:
    """Whether ``region`` holds a window of a long item in order, to a share of ``STRONG``."""
    least = STRONG * len(window)
    return sum((Counter(window) & Counter(region)).values()) >= least and common(window, region) >= least


def _verifier(candidates, items: dict[int, tuple[list[str], list[str]]], windows: list[list[str]], owner: list[int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            listed: dict[int, list[tuple[int, int, float]]] = {}
            for k, *candidate in candidates(frame):
                listed.setdefault(k, []).append(candidate)
            docs, texts = frame["doc_id"].tolist(), frame["_text"].tolist()
            for row, found in listed.items():
                doc, text = docs[row], texts[row]
                # Words without punctuation, at the places of the plain split that passages count in.
                words = list(bare((text or "").lower().split()))
                best: dict[int, tuple] = {}
                judged: dict[tuple[int, int], tuple[float, float, bool]] = {}

                def around(place: int, width: int) -> list[str]:
                    return [w for w in words[max(0, place - width):place + WINDOW + width] if w]

                for window, passage, cosine in found:
                    k, place = owner[window], passage * STRIDE
                    item, answer = items[k]
                    if (k, place) not in judged:
                        judged[k, place] = judge(item, answer, around(place, len(item)))
                    share, part, leak = judged[k, place]
                    if not leak and len(item) > WINDOW and excerpt(windows[window], around(place, WINDOW)):
                        region = around(place, len(item))
                        share, part, leak = common(item, region) / len(item), common(answer, region) / len(answer) if answer else 0.0, True
                    if leak and (share, part, cosine) > best.get(k, (-1.0,)):
                        best[k] = (share, part, cosine, place)
                out += [(doc, i, s, p, x, at) for i, (s, p, x, at) in best.items()]
            yield pd.DataFrame(out, columns=["doc_id", "item", "lcs_share", "answer_share", "cosine", "word_at"])
    return run


# --- Spark -------------------------------------------------------------------------------------

def _part(docs: DataFrame, items: list[tuple], kind: str) -> DataFrame:
    """Leaks of some benchmark items; ``docs(doc_id, _text)``."""
    texts = [tokens(t) for _, t in items]
    vocabulary = sorted({w for ws in texts for w in ws})
    seen, total = frequencies(docs, vocabulary)
    rarity = {w: np.log((1 + total) / (1 + n)) + 1e-3 for w, n in zip(vocabulary, seen.tolist())}
    kept, windows, owner = set(), [], []
    for k, ws in enumerate(texts):
        for window in item_windows(ws):
            kept.update(sorted(set(window), key=lambda w: (-rarity[w], w))[:RAREST])
            windows.append(window)
            owner.append(k)
    terms = sorted(kept)
    place = lookup(terms)
    idf = np.array([rarity[w] for w in terms])
    bench = Sparse.of([{place[w]: (1 + np.log(n)) * idf[place[w]] for w, n in Counter(x for x in window if x in place).items()}
                       for window in windows])
    sparse = stored(docs.mapInArrow(_sparse(terms, bench.largest(len(terms))),
                                    f"doc_id {kind}, p array<int>, t array<int>, n array<int>, _text string"), "passages")
    space = latent(sparse.select("p", "t", "n"), idf, bench)
    checked = sparse.where(F.col("_text").isNotNull()).mapInPandas(
        _verifier(_candidates(space, idf, bench), {k: (ws, answer_of(items[k][1])) for k, ws in enumerate(texts)}, windows, owner),
        f"doc_id {kind}, item int, lcs_share double, answer_share double, cosine double, word_at long")
    names = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    return checked.join(names, "item").drop("item")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, lcs_share, answer_share, cosine, word_at)``: one row per document and leaked item.

    NULL or empty texts and items hold nothing. Documents that share an id are one: their best match
    counts. Items under five words leak only as a whole; of items longer than WINDOW words an excerpt of
    about a window is a leak, with the shares of the whole item in its row. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    parts = -(-items.count() // PART)
    out = spark.createDataFrame([], f"doc_id {kind}, lcs_share double, answer_share double, cosine double, word_at long, item_id long")
    for p in range(parts):
        some = [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).orderBy("i", "t").collect() if tokens(r.t)]
        if some:
            out = out.unionByName(_part(plain, some, kind))
    best = F.struct("lcs_share", "answer_share", "cosine", (-F.col("word_at")).alias("before"))
    return out.groupBy("doc_id", "item_id").agg(F.max(best).alias("b")).select(
        "doc_id", "item_id", "b.lcs_share", "b.answer_share", "b.cosine", (-F.col("b.before")).alias("word_at"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that hold a leaked item."""
    name, = fresh(docs.columns, "_bad")
    bad = stored(leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(name)).distinct(), "leaky")
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
