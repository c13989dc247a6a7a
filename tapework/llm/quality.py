"""Quality classifier by co-training.

Two views of a document: its text (hashed words, and shares of symbols, capitals, repeats and
separators) and its metadata (source, language, both together, whether a length is stated), which has
nothing of the content. Each view has a logistic classifier. Over a few rounds each scores a pool of
unlabelled documents and hands its surest ones, with their pseudo-labels, to the other; then both are
calibrated on labelled documents, each scored by a classifier that has not seen it, and the calibrated
log odds are combined with weights learned there, none of them negative.

A view that ranks held-out documents no better than chance (``live``) hands nothing over and has weight
0. What is handed over stays only if it does not raise the receiving view's held-out loss, and views
are combined only if that does not raise the loss of the better one.

Training uses bounded samples (parameters below, chosen by hash of the id); scoring runs over all
documents and whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapework.llm.common import prepare

#: Labelled and unlabelled documents to learn from: those with the smallest hashes.
LABELLED = 2000
POOL = 2000
ROUNDS = 4
#: Pseudo-labels that a view hands over in a round, per class at most, and the least certainty.
HANDED = 150
SURE = 0.95
HOLD_OUT = 4  # parts of the labelled documents, each held out once to calibrate
BUCKETS = 1 << 14
SHARES = 14
META = 1 << 10
KEEP = 0.5
#: Share of the good documents that may lie below what the bound goes half way up to.
GOOD_BELOW = 0.01

_CACHE = 200_000


# --- views -------------------------------------------------------------------------------------

class TextView:
    """Sparse text features: hashed words by log count, scaled to length one, and dense shares."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}

    def slot(self, word: str) -> int:
        at = self.slots.get(word)
        if at is None:
            if len(self.slots) >= _CACHE:
                self.slots.clear()
            at = self.slots[word] = crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return at

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        n, size = max(len(words), 1), max(len(text), 1)
        lines = text.count("\n") + 1
        top = max(counts.values(), default=0)
        raw = text.encode("utf-8", "surrogatepass")
        letters = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        symbols = len(raw) - len(raw.translate(None, b"%$#&*|!<>{}[]=_~^\\"))
        digits = len(raw) - len(raw.translate(None, b"0123456789"))
        stops = len(raw) - len(raw.translate(None, b".,;:?"))
        shares = np.array((
            1.0, letters / size, symbols / size * 5, digits / size * 5, stops / size * 10, len(counts) / n, top / n,
            min(size / n, 30) / 30, np.log1p(n) / 10, np.log1p(lines) / 5, n == 1, len(words) == 0,
            min(n / lines, 200) / 200, text.count(" | ") / n * 4))
        ids = np.fromiter((self.slot(w) for w in counts), np.int64, len(counts))
        values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        if len(values):
            values /= np.sqrt((values * values).sum())
        return np.concatenate((ids, BUCKETS + np.arange(SHARES))), np.concatenate((values, shares))


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the page's metadata. A NULL field has a slot of its own."""
    keys = [f"s:{source}", f"l:{lang}", f"sl:{source}:{lang}", "bias", f"x:{n_chars is None or n_chars != n_chars}"]
    return np.array([crc32(k.encode("utf-8", "surrogatepass")) % META for k in keys]), np.ones(len(keys))


# --- classifiers -------------------------------------------------------------------------------

Rows = list[tuple[np.ndarray, np.ndarray]]


def _flat(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.int64)
    values = np.concatenate([r[1] for r in rows]) if rows else np.empty(0)
    return ids, values, np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])


def scores(w: np.ndarray, rows: Rows) -> np.ndarray:
    ids, values, owner = _flat(rows)
    return np.bincount(owner, w[ids] * values, len(rows)) if len(rows) else np.empty(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _descend(w: np.ndarray, value, gradient, direction, steps: int, least: float) -> np.ndarray:
    """Newton steps, each halved until the value falls."""
    now = value(w)
    for _ in range(steps):
        g = gradient(w)
        if np.abs(g).max() < least:
            break
        step = direction(w, g)
        for _ in range(40):
            after = value(w - step)
            if after <= now:
                break
            step = step / 2
        else:
            break
        w, now = w - step, after
    return w


def _loss(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Negative log likelihood of targets ``y`` at log odds ``x``."""
    return np.logaddexp(0, x) - y * x


def logistic(rows: Rows, y: np.ndarray, width: int, penalty: float = 0.2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression with balanced classes and a squared penalty, by Newton steps
    whose directions come from conjugate gradients."""
    if not len(rows) or y.min() == y.max():
        return np.zeros(width)
    ids, values, owner = _flat(rows)
    share = y.mean()
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))

    def at(w: np.ndarray) -> np.ndarray:
        return np.bincount(owner, w[ids] * values, len(rows))

    def back(u: np.ndarray) -> np.ndarray:
        return np.bincount(ids, u[owner] * values, width)

    def direction(w: np.ndarray, g: np.ndarray) -> np.ndarray:
        p = _sigmoid(at(w))
        curve = weight * p * (1 - p)
        out, rest, way = np.zeros(width), g.copy(), g.copy()
        left = first = rest @ rest
        for _ in range(100):
            bent = back(curve * at(way)) + penalty * way
            step = left / (way @ bent)
            out += step * way
            rest -= step * bent
            new = rest @ rest
            if new < 1e-4 * first:
                break
            way, left = rest + new / left * way, new
        return out

    return _descend(np.zeros(width), lambda w: (weight * _loss(at(w), y)).sum() + penalty / 2 * (w @ w),
                    lambda w: back(weight * (_sigmoid(at(w)) - y)) + penalty * w, direction, steps, 1e-5)


def calibrate(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Platt scaling of one or several score columns: weights, none of them negative, and intercept.

    Both classes have equal weight, so that even odds lie between them however rare one is. Smoothed
    targets and a squared penalty on all of them keep separable data finite. A column that would get a
    negative weight, or the most negative of several, has weight 0 and the others are fitted anew.
    """
    up, down = (y > 0.5).sum(), (y <= 0.5).sum()
    weight = np.where(y > 0.5, len(y) / max(2 * up, 1), len(y) / max(2 * down, 1))
    t = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    out, used = np.zeros(x.shape[1] + 1), list(range(x.shape[1]))
    while True:
        m = np.column_stack((x[:, used], np.ones(len(x))))

        def direction(w: np.ndarray, g: np.ndarray) -> np.ndarray:
            p = _sigmoid(m @ w)
            return np.linalg.solve((m * (weight * p * (1 - p))[:, None]).T @ m + penalty * np.eye(len(w)), g)

        w = _descend(np.zeros(len(used) + 1), lambda w: (weight * _loss(m @ w, t)).sum() + penalty / 2 * (w @ w),
                     lambda w: m.T @ (weight * (_sigmoid(m @ w) - t)) + penalty * w, direction, steps, 1e-9)
        if not used or w[:-1].min() >= 0:
            out[[*used, -1]] = w
            return out
        used.pop(int(np.argmin(w[:-1])))


def auc(x: np.ndarray, y: np.ndarray) -> float:
    """How often a good document scores above a bad one, ties half."""
    order, n = np.unique(x, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[np.searchsorted(order, x)]
    up = (y > 0.5).sum()
    return float((rank[y > 0.5].sum() - up * (up + 1) / 2) / (up * (len(y) - up)))


def live(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether scores rank better than chance by three deviations of chance."""
    up = (y > 0.5).sum()
    return auc(x, y) - 0.5 > 3 * np.sqrt((len(y) + 1) / (12 * up * (len(y) - up)))


@dataclass
class Model:
    text: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + SHARES))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(META))
    text_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    meta_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    joint: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))
    #: Without labels of both classes, or where neither view beats chance, nothing is rejected.
    blind: bool = True
    #: Pseudo-labels taken from the text view and from the metadata view.
    handed: tuple[int, int] = (0, 0)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: of the text view, of the metadata view, of both."""
        a = text * self.text_scale[0] + self.text_scale[1]
        b = meta * self.meta_scale[0] + self.meta_scale[1]
        both = _sigmoid(a * self.joint[0] + b * self.joint[1] + self.joint[2])
        return _sigmoid(a), _sigmoid(b), np.ones(len(both)) if self.blind else both


def co_train(text: Rows, meta: Rows, y: np.ndarray, pool_text: Rows, pool_meta: Rows, rounds: int = ROUNDS) -> Model:
    """``y``: 1 good, 0 bad for the labelled rows, in a fixed order."""
    model = Model()
    if len(y) == 0 or y.min() == y.max():
        return model
    part = np.arange(len(y)) % HOLD_OUT
    views = {"text": (text, pool_text, BUCKETS + SHARES), "meta": (meta, pool_meta, META)}
    base = max(y.mean(), 1e-3)

    @dataclass
    class View:
        weights: np.ndarray
        scale: np.ndarray
        odds: np.ndarray  # calibrated, of the labelled rows while held out
        loss: float
        live: bool

    def learnt(view: str, gifts: dict[int, float]) -> View:
        rows, pool, width = views[view]
        more = sorted(gifts.items())

        def fit(some: np.ndarray) -> np.ndarray:
            return logistic([rows[i] for i in some] + [pool[i] for i, _ in more], np.concatenate((y[some], [v for _, v in more])), width)

        # Scores of every labelled row by a classifier that has not seen it.
        raw = np.zeros(len(y))
        for k in range(HOLD_OUT):
            out = np.nonzero(part == k)[0]
            raw[out] = scores(fit(np.nonzero(part != k)[0]), [rows[i] for i in out])
        scale = calibrate(raw[:, None], y)
        odds = raw * scale[0] + scale[1]
        return View(fit(np.arange(len(y))), scale, odds, float(_loss(odds, y).sum()), live(raw, y))

    # What each view has from the other: pool rows with pseudo-labels.
    gifts: dict[str, dict[int, float]] = {"text": {}, "meta": {}}
    state = {v: learnt(v, {}) for v in views}
    open_ = {("text", "meta"), ("meta", "text")} if pool_text else set()
    for _ in range(rounds):
        for giver, taker in sorted(open_):
            if not state[giver].live:
                continue
            p = _sigmoid(scores(state[giver].weights, views[giver][1]) * state[giver].scale[0] + state[giver].scale[1])
            new = dict(gifts[taker])
            for label, sure, most in ((1.0, p, round(HANDED * base) + 1), (0.0, 1 - p, round(HANDED * (1 - base)) + 1)):
                order = [i for i in np.argsort(-sure, kind="stable") if sure[i] >= SURE and i not in gifts[taker]]
                new.update((int(i), label) for i in order[:most])
            tried = learnt(taker, new) if len(new) > len(gifts[taker]) else None
            if tried and tried.loss <= state[taker].loss:
                gifts[taker], state[taker] = new, tried
            else:
                open_.discard((giver, taker))
    a, b = state["text"], state["meta"]
    model.text, model.meta, model.text_scale, model.meta_scale = a.weights, b.weights, a.scale, b.scale
    model.handed = (len(gifts["meta"]), len(gifts["text"]))
    model.blind = not (a.live or b.live)
    alone = [np.array(w) for w, v in (((1.0, 0.0, 0.0), a), ((0.0, 1.0, 0.0), b)) if v.live]
    both = [calibrate(np.column_stack((a.odds, b.odds)), y)] if len(alone) == 2 else []
    if alone:
        model.joint = min(alone + both, key=lambda w: _loss(a.odds * w[0] + b.odds * w[1] + w[2], y).sum()).copy()
        # Where nearly all good documents lie well above even odds, the bound goes half way up to them.
        odds = a.odds * model.joint[0] + b.odds * model.joint[1] + model.joint[2]
        model.joint[2] -= max(0.0, float(np.quantile(odds[y > 0.5], GOOD_BELOW))) / 2
    return model


# --- Spark -------------------------------------------------------------------------------------

@dataclass
class Columns:
    id: str = "doc_id"
    text: str = "text"
    source: str = "source"
    lang: str = "lang"
    chars: str = "n_chars"


def _plain(docs: DataFrame, c: Columns) -> DataFrame:
    def of(name: str, kind: str):
        return F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)
    return docs.select(F.col(c.id).alias("doc_id"), of(c.text, "string").alias("text"), of(c.source, "string").alias("source"),
                       of(c.lang, "string").alias("lang"), of(c.chars, "double").alias("n_chars"))


def fitted(docs: DataFrame, labels: DataFrame, columns: Columns | None = None, quality: str = "quality",
           labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Learn from at most ``labelled`` labelled and ``pool`` other documents. Labels without an id
    or a quality are ignored; of labels that contradict each other the lower counts."""
    c = columns or Columns()
    plain = _plain(docs, c)
    marks = labels.where(F.col(c.id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(c.id).alias("_id")).agg(F.min(quality).alias("y"))
    ids = plain.select("doc_id").where("doc_id IS NOT NULL").distinct().join(marks, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "y", F.xxhash64("doc_id").alias("h"))
    chosen = (ids.where("y IS NOT NULL").orderBy("h", "doc_id").limit(labelled)
              .union(ids.where("y IS NULL").orderBy("h", "doc_id").limit(pool))).withColumnRenamed("doc_id", "_id")
    # At most labelled + pool ids, so this side may be broadcast whatever the corpus.
    some = plain.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        view = TextView()
        for f in frames:
            t = [view.features(x) for x in f["text"]]
            m = [meta_features(*r) for r in zip(f["source"], f["lang"], f["n_chars"])]
            yield pd.DataFrame({"h": f["h"], "y": f["y"].astype("float64"), "ti": [x[0] for x in t], "tv": [x[1] for x in t],
                                "mi": [x[0] for x in m], "mv": [x[1] for x in m]})

    rows = some.mapInPandas(featured, "h long, y double, ti array<long>, tv array<double>, mi array<long>, mv array<double>").collect()
    rows.sort(key=lambda r: (r.h, r.tv, r.ti))
    split: dict[bool, list] = {True: [], False: []}
    for r in rows:
        split[r.y is not None and r.y == r.y].append(r)
    texts, metas = ({k: [(np.array(r[a], np.int64), np.array(r[b], np.float64)) for r in v] for k, v in split.items()} for a, b in (("ti", "tv"), ("mi", "mv")))
    return co_train(texts[True], metas[True], np.array([float(r.y > 0) for r in split[True]]), texts[False], metas[False])


def scored(docs: DataFrame, model: Model, columns: Columns | None = None, keep: float = KEEP) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, keep)``, one row per document."""
    plain = _plain(docs, columns or Columns())
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        view = TextView()
        for f in frames:
            t = scores(model.text, [view.features(x) for x in f["text"]])
            m = scores(model.meta, [meta_features(*r) for r in zip(f["source"], f["lang"], f["n_chars"])])
            a, b, both = model.score(t, m)
            yield pd.DataFrame({"doc_id": f["doc_id"], "text_score": a, "meta_score": b, "score": both, "keep": (both >= keep).astype("int32")})

    return plain.mapInPandas(run, f"doc_id {kind}, text_score double, meta_score double, score double, keep int")


def classify(docs: DataFrame, labels: DataFrame, columns: Columns | None = None, keep: float = KEEP) -> DataFrame:
    """Scores of all documents by a classifier co-trained on ``labels(doc_id, quality)``.

    NULL texts are empty texts, NULL metadata has features of its own; repeated rows get equal
    scores; other columns are ignored. Without labels of both classes every score is 1.
    """
    prepare(docs.sparkSession)
    return scored(docs, fitted(docs, labels, columns), columns, keep)


def kept(docs: DataFrame, labels: DataFrame, columns: Columns | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, in one pass over the texts."""
    prepare(docs.sparkSession)
    c = columns or Columns()
    model = fitted(docs, labels, c)

    @F.pandas_udf("boolean")
    def good(text: pd.Series, source: pd.Series, lang: pd.Series, chars: pd.Series) -> pd.Series:
        view = TextView()
        t = scores(model.text, [view.features(x) for x in text])
        m = scores(model.meta, [meta_features(*r) for r in zip(source, lang, chars)])
        return pd.Series(model.score(t, m)[2] >= keep)

    def of(name: str, kind: str):
        return F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)
    return docs.where(good(of(c.text, "string"), of(c.source, "string"), of(c.lang, "string"), of(c.chars, "double")))
