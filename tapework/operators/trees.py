"""Boosted regression trees for every (ticker, fold) in the same jobs.

Features are cut into ``BINS`` ranges by quantiles of the ticker's first training block, which every
fold trains on. Trees grow leaf by leaf, best split first, from sums of residuals per (leaf, feature,
bin). Residuals, leaf values and predictions are whole numbers on a grid of ``GRID`` steps per deviation
of the target, so sums are exact: results depend neither on partitions nor on the order of rows, nor on
the units of the target. The last part of the training rows tells the best round; a fit ends after
``patience`` rounds without a better one.

A (ticker, fold) of at most ``TASK_ROWS`` rows is fitted by one task, and all of those run in one job.
Longer ones stay spread over the cluster: per level of their trees one job sums the histograms of
all of them, and only histograms come to the driver. Both give the same trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.operators import series as R
from tapework.operators import splits
from tapework.operators.model import KEYS, train_stats, trial_losses
from tapework.session import materialize

BINS = 64
GRID = 1 << 16
#: Rows of a (ticker, fold) that one task may hold, with their features.
TASK_ROWS = 500_000
#: Longer ones that are fitted by the same jobs, and rounds after which their predictions are stored.
TOGETHER = 64
KEPT_ROUNDS = 8
#: Share of the training rows, the latest ones, that tells when to stop.
HOLDOUT = 0.1
TRAIN, LATE, TEST = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    leaves: int = 31
    rate: float = 0.05
    #: Shares of the features of a tree and of the rows of a bag, which is drawn every ``bag_every`` rounds.
    features: float = 0.8
    rows: float = 0.8
    bag_every: int = 5
    #: Rows of a leaf.
    least: int = 20
    rounds: int = 500
    patience: int = 50
    seed: int = 42


# --- one tree ----------------------------------------------------------------------------------

def scramble(x: np.ndarray | int, *salts: int) -> np.ndarray:
    """Well mixed 64-bit numbers from whole numbers; the same on every machine."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        for s in salts:
            x = x + np.uint64(s & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return x


def in_bag(pos: np.ndarray, s: Settings, k: int) -> np.ndarray:
    """Rows of the bag of round ``k``, by their positions."""
    return scramble(pos, s.seed, k // s.bag_every) < np.uint64(min(int(s.rows * 2.0**64), 2**64 - 1))


def drawn(n: int, s: Settings, k: int) -> np.ndarray:
    """Features of the tree of round ``k``, ascending."""
    return np.sort(np.argsort(scramble(np.arange(n), s.seed, -1 - k), kind="stable")[:max(1, round(n * s.features))])


Split = tuple[float, int, int]  # gain, feature, last bin of the left side


def best_split(sums: np.ndarray, counts: np.ndarray, cols: np.ndarray, least: int) -> Split | None:
    """The split of a leaf with the largest gain; ``sums`` and ``counts``: features x bins. The first of equal ones."""
    total, n = sums[cols[0]].sum(), counts[cols[0]].sum()
    if n < 2 * least:
        return None
    left, m = np.cumsum(sums[cols], axis=1)[:, :-1], np.cumsum(counts[cols], axis=1)[:, :-1]
    fits = (m >= least) & (n - m >= least)
    if not fits.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left * left / m + (total - left) ** 2 / (n - m) - total * total / n, -np.inf)
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), int(cols[f]), b) if gain[f, b] > 1e-9 * max(1.0, total * total / n) else None


def leaf_value(total: float, n: float, rate: float) -> int:
    return int(round(rate * total / n)) if n else 0


class Grown:
    """A tree of leaves found so far: splits in their order (leaf, feature, bin); a split's right side
    becomes leaf number ``len(splits)``, its left side keeps the leaf's number."""

    def __init__(self) -> None:
        self.splits: list[tuple[int, int, int]] = []
        self.values: list[int] = []

    def of(self, bins: np.ndarray) -> np.ndarray:
        """Values of rows; a tree without splits adds nothing."""
        if not self.splits:
            return np.zeros(len(bins), np.int64)
        out = np.zeros(len(bins), np.int32)
        for k, (leaf, f, b) in enumerate(self.splits):
            out[(out == leaf) & (bins[:, f] > b)] = k + 1
        return np.array(self.values, np.int64)[out]


# --- a fit in one task -------------------------------------------------------------------------

class Fit:
    """Boosting of one group. ``bins``: rows x features; ``y``: targets on the grid, 0 is the mean."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, pos: np.ndarray, role: np.ndarray, s: Settings):
        self.s, self.bins, self.y, self.pos = s, bins, y, pos
        self.codes = bins.astype(np.int32) + BINS * np.arange(bins.shape[1], dtype=np.int32)
        self.train = np.nonzero(role == TRAIN)[0]
        late = np.nonzero(role == LATE)[0]
        self.judge = late if len(late) else self.train
        self.pred = np.zeros(len(y), np.int64)
        self.best, self.best_loss, self.best_pred, self.k = 0, self._loss(), self.pred.copy(), 0

    def _loss(self) -> int:
        wrong = self.y[self.judge] - self.pred[self.judge]
        return int((wrong * wrong).sum())

    @property
    def done(self) -> bool:
        return self.k >= self.s.rounds or self.k - self.best >= self.s.patience or len(self.train) < 2 * self.s.least

    def run(self, until: int) -> Fit:
        while not self.done and self.k < until:
            tree = self._tree()
            self.k += 1
            if not tree.splits:
                continue
            self.pred += tree.of(self.bins)
            loss = self._loss()
            if loss < self.best_loss:
                self.best, self.best_loss, self.best_pred = self.k, loss, self.pred.copy()
        return self

    def _histogram(self, rows: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = self.bins.shape[1], BINS
        at = self.codes[rows].ravel()
        sums = np.bincount(at, weights=np.repeat(residual[rows], shape[0]), minlength=shape[0] * BINS)
        return sums.reshape(shape), np.bincount(at, minlength=shape[0] * BINS).reshape(shape)

    def _tree(self) -> Grown:
        s, tree = self.s, Grown()
        residual = (self.y - self.pred).astype(np.float64)
        cols = drawn(self.bins.shape[1], s, self.k)
        bag = self.train[in_bag(self.pos[self.train], s, self.k)]
        held = {0: (bag, *self._histogram(bag, residual))}
        open_: list[tuple[float, int, int, int]] = []

        def offer(leaf: int) -> None:
            split = best_split(held[leaf][1], held[leaf][2], cols, s.least)
            if split:
                heapq.heappush(open_, (-split[0], leaf, split[1], split[2]))

        offer(0)
        while open_ and len(tree.splits) < s.leaves - 1:
            _, leaf, f, b = heapq.heappop(open_)
            rows, sums, counts = held[leaf]
            right = self.bins[rows, f] > b
            left, right = rows[~right], rows[right]
            small = left if len(left) <= len(right) else right
            a = self._histogram(small, residual)
            z = sums - a[0], counts - a[1]
            new = len(tree.splits) + 1
            tree.splits.append((leaf, f, b))
            held[leaf], held[new] = (left, *(a if small is left else z)), (right, *(z if small is left else a))
            offer(leaf)
            offer(new)
        tree.values = [leaf_value(held[k][1][0].sum(), held[k][2][0].sum(), s.rate) for k in range(len(tree.splits) + 1)]
        return tree


def edges_of(values: np.ndarray) -> np.ndarray:
    """Upper ends of the bins of a column but the last: quantiles that are values of the column."""
    known = values[~np.isnan(values)]
    return np.unique(np.quantile(known, np.arange(1, BINS) / BINS, method="inverted_cdf")) if len(known) else np.empty(0)


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bins of a column; missing values share the first one."""
    out = np.searchsorted(edges, values, "left")
    out[np.isnan(values)] = 0
    return out.astype(np.uint8)


def on_grid(y: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.rint((y - mean) / std * GRID).astype(np.int64)


# --- rows --------------------------------------------------------------------------------------

def _rows(frame: DataFrame, names: Sequence[str], target: str, n_splits: int, holdout: float) -> DataFrame:
    """Rows of all folds with their role, the fold's mean and deviation of the target; a row of a later
    segment is in fewer folds."""
    segmented = materialize(splits.with_segments(frame.select("ticker", "date", *names, F.col(target).alias("_y")), n_splits=n_splits), "segments")
    stats = train_stats(segmented, ["_y"]).select(
        "ticker", "fold", F.col("_y_mean").alias("_mean"), F.coalesce(F.nullif("_y_std", F.lit(0.0)), F.lit(1.0)).alias("_std"))
    end = F.expr(f"{R.ROWS} - ({n_splits} - fold) * ({R.ROWS} div {n_splits + 1})")
    folds = F.explode(F.sequence(F.greatest(F.col("segment") - 1, F.lit(0)), F.lit(n_splits - 1)))
    rows = segmented.withColumn("fold", folds).join(stats, KEYS)
    late = end - F.floor(end * F.lit(holdout))
    return rows.withColumn("_end", end).withColumn(
        "_role", F.when(F.col("segment") == F.col("fold") + 1, F.lit(TEST)).when(F.col(R.POS) >= late, F.lit(LATE)).otherwise(F.lit(TRAIN)))


def _spread(rows: DataFrame) -> DataFrame:
    """Whole groups in tasks, as many tasks as the session shuffles to: fits are worth a task each however
    few their bytes are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS)


def _group(pdf: pd.DataFrame, names: Sequence[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows of a group in order, their bins and their targets on the grid."""
    pdf = pdf.sort_values(R.POS, kind="stable")
    first = (pdf["segment"] == 0).to_numpy()
    columns = [pdf[c].to_numpy(dtype=float) for c in names]
    bins = np.column_stack([binned(x, edges_of(x[first])) for x in columns])
    return pdf, bins, on_grid(*(pdf[c].to_numpy(dtype=float) for c in ("_y", "_mean", "_std")))


_OUT = "ticker string, fold bigint, date date, pred double, actual double, rounds int"


def _predicted(pdf: pd.DataFrame, pred: np.ndarray, rounds: int) -> pd.DataFrame:
    test = (pdf["_role"] == TEST).to_numpy()
    out = pdf.loc[test, ["ticker", "fold", "date"]].copy()
    out["pred"] = pred[test] / GRID * pdf["_std"][test] + pdf["_mean"][test]
    out["actual"], out["rounds"] = pdf["_y"][test], rounds
    return out


def gbt_forecast(frame: DataFrame, names: Sequence[str], target: str = "target", n_splits: int = S.N_SPLITS,
                 settings: Settings = Settings(), holdout: float = HOLDOUT) -> DataFrame:
    """Predictions of the test rows of every fold, ``rounds``: trees of the best round (0: the mean alone).

    Missing features share the first bin. A fold with fewer training rows than two leaves predicts its mean.
    """
    names = list(names)
    rows = _rows(frame, names, target, n_splits, holdout)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, bins, y = _group(pdf, names)
        done = Fit(bins, y, pdf[R.POS].to_numpy(), pdf["_role"].to_numpy(), settings).run(settings.rounds)
        return _predicted(pdf, done.best_pred, done.best)

    out = _spread(rows.where(F.col(R.ROWS) <= TASK_ROWS)).groupBy(*KEYS).applyInPandas(fit, _OUT)
    for part, groups in _long(rows, names):
        out = out.unionByName(_LongFit(part, groups, settings).run().predictions())
    return out


# --- search ------------------------------------------------------------------------------------

def composite(y: np.ndarray, pred: np.ndarray) -> float:
    """The composite loss of ``functions.metrics`` on arrays."""
    wrong = np.abs(y - pred)
    spread = ((y - y.mean()) ** 2).sum()
    r2 = 1 - (wrong ** 2).sum() / spread if spread else 0.0
    return 0.4 * float((wrong / np.maximum(np.abs(y), np.finfo(float).eps)).mean()) + 0.4 * (1 - r2) + 0.2 * wrong.mean() / max(np.abs(y).mean(), 1e-300)


def space(trials: int = 15, seed: int = 42) -> list[Settings]:
    """Settings drawn from a search space; the first are the defaults."""
    draws = scramble(np.arange(trials * 5).reshape(trials, 5), seed).astype(np.float64) / 2.0**64
    return [Settings()] + [Settings(leaves=int(8 + 56 * d[0]), rate=float(np.round(10 ** (-2 + d[1]), 4)), features=float(np.round(0.5 + d[2] / 2, 2)),
                                    rows=float(np.round(0.5 + d[3] / 2, 2)), least=int(10 + 50 * d[4])) for d in draws[1:]]


def gbt_search(frame: DataFrame, names: Sequence[str], trials: Sequence[Settings], target: str = "target", n_splits: int = S.N_SPLITS,
               holdout: float = HOLDOUT, first: int = 25) -> DataFrame:
    """``(ticker, fold, trial, rounds, loss, stopped)`` of every trial of every fold.

    All trials of a group share its binned rows. They run ``first`` rounds, the worse half by the composite
    loss of the held-out rows is dropped, the others run twice as many, and so on; ``stopped`` is the
    round at which a trial was dropped, NULL for those that ran to their end. The last trial to stay has
    the fit that it has alone.
    """
    names, trials = list(names), list(trials)
    rows = _rows(frame, names, target, n_splits, holdout)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, bins, y = _group(pdf, names)
        role, mean, std = pdf["_role"].to_numpy(), pdf["_mean"].to_numpy(), pdf["_std"].to_numpy()
        judge = role == (LATE if (role == LATE).any() else TRAIN)
        actual = pdf["_y"].to_numpy(dtype=float)[judge]
        fits = [Fit(bins, y, pdf[R.POS].to_numpy(), role, s) for s in trials]

        def loss(t: int) -> float:
            return composite(actual, (fits[t].best_pred / GRID * std + mean)[judge])

        stopped: dict[int, int] = {}
        alive, until = list(range(len(trials))), first
        while alive:
            for t in alive:
                fits[t].run(until)
            if all(fits[t].done for t in alive):
                break
            order = sorted(alive, key=lambda t: (loss(t), t))
            for t in order[-(-len(order) // 2):]:
                if not fits[t].done:
                    stopped[t] = fits[t].k
            alive = sorted(order[:-(-len(order) // 2)])
            until *= 2
        return pd.DataFrame([(pdf["ticker"].iloc[0], pdf["fold"].iloc[0], t, fits[t].best, loss(t), stopped.get(t)) for t in range(len(trials))],
                            columns=["ticker", "fold", "trial", "rounds", "loss", "stopped"]).astype({"stopped": "Int32"})

    out = _spread(rows.where((F.col(R.ROWS) <= TASK_ROWS) & (F.col("_role") != TEST))).groupBy(*KEYS).applyInPandas(
        search, "ticker string, fold bigint, trial int, rounds int, loss double, stopped int")
    for part, groups in _long(rows, names):
        for t, s in enumerate(trials):
            out = out.unionByName(_LongFit(part, groups, s).run().losses(t))
    return out


# --- fits spread over the cluster --------------------------------------------------------------

def _long(rows: DataFrame, names: list[str]) -> Iterator[tuple[DataFrame, list[tuple]]]:
    """Parts of at most ``TOGETHER`` long groups: their rows with bins and grid targets, and the groups."""
    long = rows.where(F.col(R.ROWS) > TASK_ROWS)
    tickers = sorted(r.ticker for r in long.select("ticker").distinct().collect())
    folds = [r.fold for r in long.select("fold").distinct().orderBy("fold").collect()] if tickers else []
    size = max(1, TOGETHER // max(1, len(folds)))
    for a in range(0, len(tickers), size):
        some = tickers[a:a + size]
        mine = long.where(F.col("ticker").isin(some))
        cuts = mine.where("segment = 0 and fold = 0").groupBy("ticker").agg(*[
            F.percentile_approx(F.when(~F.isnan(c), F.col(c)), [k / BINS for k in range(1, BINS)], 100_000).alias(c) for c in names])
        edges = {r.ticker: [np.unique(r[c]) if r[c] else np.empty(0) for c in names] for r in cuts.collect()}
        groups = [(t, f) for t in some for f in folds]
        number = {g: i for i, g in enumerate(groups)}

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                bins = np.zeros((len(pdf), len(names)), np.uint8)
                for ticker, at in pdf.groupby("ticker").indices.items():
                    for j, c in enumerate(names):
                        bins[at, j] = binned(pdf[c].to_numpy(dtype=float)[at], edges[ticker][j])
                y = on_grid(*(pdf[c].to_numpy(dtype=float) for c in ("_y", "_mean", "_std")))
                yield pd.DataFrame({
                    "g": [number[x] for x in zip(pdf["ticker"], pdf["fold"])], "date": pdf["date"], "pos": pdf[R.POS], "role": pdf["_role"],
                    "y": y, "p": 0, "bins": [b.tobytes() for b in bins], "actual": pdf["_y"], "mean": pdf["_mean"], "std": pdf["_std"]})

        yield materialize(mine.mapInPandas(cut, _STATE), "long-rows"), groups


_STATE = "g int, date date, pos bigint, role int, y bigint, p bigint, bins binary, actual double, mean double, std double"


class _Candidate:
    """A node of a tree that may be split: its histogram's totals and best split, and its sides."""

    def __init__(self, sums: np.ndarray, counts: np.ndarray, cols: np.ndarray, s: Settings):
        self.total, self.n = sums[0].sum(), counts[0].sum()
        self.split = best_split(sums, counts, cols, s.least)
        self.sides: tuple[_Candidate, _Candidate] | None = None


def _greedy(root: _Candidate, leaves: int) -> tuple[Grown, list[str], dict[str, int]]:
    """Best-first growth as far as the nodes are known: the tree, the paths of nodes whose sides are
    wanted, and the leaf of each path."""
    tree, at = Grown(), {0: ("", root)}
    open_ = [(-root.split[0], 0)] if root.split else []
    while open_ and len(tree.splits) < leaves - 1:
        _, leaf = heapq.heappop(open_)
        path, node = at[leaf]
        if node.sides is None:
            # This node and any open one that the leaves left could still reach.
            room = leaves - 1 - len(tree.splits)
            return tree, [path] + [at[x][0] for _, x in heapq.nsmallest(room - 1, open_) if at[x][1].sides is None], {}
        new = len(tree.splits) + 1
        tree.splits.append((leaf, *node.split[1:]))
        at[leaf], at[new] = (path + "0", node.sides[0]), (path + "1", node.sides[1])
        for x in (leaf, new):
            if at[x][1].split:
                heapq.heappush(open_, (-at[x][1].split[0], x))
    return tree, [], {path: leaf for leaf, (path, _) in at.items()} | {"": 0}


class _LongFit:
    """Boosting of several long groups: rows in a table, trees and histograms on the driver."""

    def __init__(self, state: DataFrame, groups: list[tuple], s: Settings):
        self.state, self.groups, self.s = state, groups, s
        self.width = len(state.select("bins").first().bins)
        self.trees: dict[int, list[Grown]] = {g: [] for g in range(len(groups))}
        self.stored = 0  # rounds whose trees are in the table's predictions
        self.best = {g: 0 for g in self.trees}
        self.loss: dict[int, int] = {}
        self.open = set(self.trees)

    def _each(self, work: Callable, schema: str, roles: Sequence[int] | None = None) -> DataFrame:
        """``work(group, rows, bins, prediction)`` over the open groups' rows of every batch."""
        trees, width, some = {g: self.trees[g][self.stored:] for g in self.open}, self.width, sorted(self.open)
        source = self.state.where(F.col("g").isin(some))
        source = source.where(F.col("role").isin(list(roles))) if roles else source

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for g, part in pdf.groupby("g"):
                    bins = np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(-1, width)
                    pred = part["p"].to_numpy().copy()
                    for tree in trees[g]:
                        pred += tree.of(bins)
                    out = work(int(g), part, bins, pred)
                    if out is not None:
                        yield out

        return source.mapInPandas(run, schema)

    def _histograms(self, k: int, wanted: dict[int, list[str]], known: dict[int, dict[str, Split]]) -> dict:
        """Histograms of the nodes at ``wanted`` paths, from one job."""
        s, width = self.s, self.width

        def work(g, part, bins, pred):
            bag = in_bag(part["pos"].to_numpy(), s, k)
            bins, residual = bins[bag], (part["y"].to_numpy() - pred)[bag]
            frames = []
            for path in wanted.get(g, ()):
                rows = np.ones(len(bins), bool)
                for depth, side in enumerate(path):
                    _, f, b = known[g][path[:depth]]
                    rows &= (bins[:, f] > b) == (side == "1")
                at = (bins[rows].astype(np.int64) + BINS * np.arange(width)).ravel()
                n = np.bincount(at, minlength=width * BINS)
                sums = np.bincount(at, weights=np.repeat(residual[rows], width), minlength=width * BINS)
                cell = np.nonzero(n)[0]
                frames.append(pd.DataFrame({"g": g, "path": path, "cell": cell, "s": sums[cell].astype(np.int64), "n": n[cell]}))
            return pd.concat(frames) if frames else None

        out: dict = {}
        cells = self._each(work, "g int, path string, cell int, s bigint, n bigint", [TRAIN]).groupBy("g", "path", "cell").agg(
            F.sum("s").alias("s"), F.sum("n").alias("n"))
        for r in cells.toLocalIterator():  # features x bins numbers a node
            sums, counts = out.setdefault((r.g, r.path), (np.zeros(width * BINS), np.zeros(width * BINS, np.int64)))
            sums[r.cell], counts[r.cell] = r.s, r.n
        return {key: (a.reshape(width, BINS), b.reshape(width, BINS)) for key, (a, b) in out.items()}

    def _round(self, k: int) -> dict[int, Grown]:
        cols = drawn(self.width, self.s, k)
        empty = np.zeros((self.width, BINS)), np.zeros((self.width, BINS), np.int64)
        wanted = {g: [""] for g in self.open}
        nodes: dict[int, dict[str, _Candidate]] = {g: {} for g in self.open}
        grown: dict[int, Grown] = {}
        while wanted:
            found = self._histograms(k, wanted, {g: {p: c.split for p, c in nodes[g].items() if c.split} for g in wanted})
            again = {}
            for g, paths in wanted.items():
                for p in paths:
                    nodes[g][p] = _Candidate(*found.get((g, p), empty), cols, self.s)
                for p in {p[:-1] for p in paths if p}:
                    nodes[g][p].sides = nodes[g][p + "0"], nodes[g][p + "1"]
                tree, more, leaf = _greedy(nodes[g][""], self.s.leaves)
                if more:
                    again[g] = [p + side for p in more for side in "01"]
                else:
                    where = {x: p for p, x in leaf.items() if p or len(leaf) == 1}
                    tree.values = [leaf_value(nodes[g][where[x]].total, nodes[g][where[x]].n, self.s.rate) for x in range(len(tree.splits) + 1)]
                    grown[g] = tree
            wanted = again
        return grown

    def _losses(self) -> dict[int, int]:
        def work(g, part, bins, pred):
            wrong = part["y"].to_numpy() - pred
            return pd.DataFrame({"g": [g], "s": [int((wrong * wrong).sum())]})

        late = {r.g for r in self.state.where(F.col("role") == LATE).select("g").distinct().collect()}
        role = LATE if late >= self.open else TRAIN
        return {r.g: r.s for r in self._each(work, "g int, s bigint", [role]).groupBy("g").agg(F.sum("s").alias("s")).collect()}

    def _store(self) -> None:
        """Predictions of all trees so far into the table."""
        added = {g: t[self.stored:] for g, t in self.trees.items()}
        self.state = materialize(self._applied(added, "p"), "long-rows")
        self.stored = max(map(len, self.trees.values()))

    def _applied(self, trees: dict[int, list[Grown]], base: str | None) -> DataFrame:
        """The table with predictions of some trees on top of a column, or of nothing."""
        width = self.width

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pred = pdf[base].to_numpy().copy() if base else np.zeros(len(pdf), np.int64)
                for g, at in pdf.groupby("g").indices.items():
                    bins = np.frombuffer(b"".join(pdf["bins"].iloc[at]), np.uint8).reshape(-1, width)
                    for tree in trees[g]:
                        pred[at] += tree.of(bins)
                yield pdf.assign(p=pred)

        return self.state.mapInPandas(apply, _STATE)

    def run(self) -> _LongFit:
        self.loss = self._losses()
        for k in range(self.s.rounds):
            grown = self._round(k)
            for g in self.trees:
                # Groups that have ended keep their place in the rounds.
                self.trees[g].append(grown.get(g) or Grown())
            for g, loss in self._losses().items():
                if loss < self.loss[g]:
                    self.loss[g], self.best[g] = loss, k + 1
            self.open = {g for g in self.open if k + 1 - self.best[g] < self.s.patience}
            if not self.open:
                break
            if (k + 1) % KEPT_ROUNDS == 0:
                self._store()
        return self

    def predictions(self, role: int = TEST) -> DataFrame:
        """Rows of a role with the predictions of their group's best round."""
        rows = self._applied({g: t[:self.best[g]] for g, t in self.trees.items()}, None).where(F.col("role") == role)

        def of(values: list):
            return F.element_at(F.array(*map(F.lit, values)), F.col("g") + 1)

        return rows.select(
            of([t for t, _ in self.groups]).alias("ticker"), of([f for _, f in self.groups]).cast("bigint").alias("fold"), "date",
            (F.col("p") / GRID * F.col("std") + F.col("mean")).alias("pred"), "actual",
            of([self.best[g] for g in range(len(self.groups))]).cast("int").alias("rounds"))

    def losses(self, trial: int) -> DataFrame:
        """Composite loss of the held-out rows as rows of ``gbt_search``."""
        losses = trial_losses(self.predictions(LATE), [*KEYS, "rounds"])
        return losses.select(*KEYS, F.lit(trial).alias("trial"), "rounds", "loss", F.lit(None).cast("int").alias("stopped"))
