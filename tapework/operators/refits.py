"""Linear models over moving data: refits before every step, and models over windows of rows.

Neither copies rows. A refit needs the cross products of all rows before its step: they are summed per
block of steps, carried along the blocks, and completed inside a block. A model over the last
``window`` rows has ``window`` inputs per feature; its windows are views of a block's own rows inside a
task, so only the rows themselves (and the few before a block) are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapework import schemas as S
from tapework.operators import series as R
from tapework.operators import splits
from tapework.operators.model import centred
from tapework.operators.stats import gram, square
from tapework.session import materialize

#: Steps of a block of refits, and rows of a block of windows.
STEPS = 256
WINDOW_ROWS = 16384
PART = "_part"


def ridge_weights(products: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, folded weights and target means of ridge regressions on standardised columns.

    ``products``: cross products of (1, columns, target), one square per model; constant columns keep a
    spread of 1. A prediction is ``target mean + (x - means) @ weights``.
    """
    n, mean = products[:, 0, 0], products[:, 0, 1:] / products[:, :1, 0]
    cov = products[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    scale = np.sqrt(np.maximum(np.einsum("kii->ki", cov)[:, :-1], 0.0))
    scale[scale == 0] = 1.0
    a = n[:, None, None] * cov[:, :-1, :-1] / (scale[:, :, None] * scale[:, None, :]) + strength * np.eye(scale.shape[1])
    b = n[:, None] * cov[:, :-1, -1] / scale
    return mean[:, :-1], np.linalg.solve(a, b[:, :, None])[:, :, 0] / scale, mean[:, -1]


def _sums_before(cells: DataFrame, order: str) -> DataFrame:
    """Cells ``ticker, order, i, j, s`` summed over the earlier values of ``order``, one row per value."""
    earlier = Window.partitionBy("ticker", "i", "j").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cells.select("ticker", order, "i", "j", F.sum("s").over(earlier).alias("s"))
    return summed.groupBy("ticker", order).agg(F.collect_list(F.struct("i", "j", F.coalesce("s", F.lit(0.0)).alias("s"))).alias("cells"))


def walk_forward_ridge(frame: DataFrame, names: Sequence[str], target: str = "target", strength: float = 1.0,
                       start: int = S.LOOKBACK, step: int = S.WALK_STEP) -> DataFrame:
    """Predictions of every step by a ridge model refitted on all rows before it; the last partial step
    is left out. One solve a step, and no training row is read again for it."""
    names = list(names)
    columns = [*names, target]
    rows = R.with_position(frame.select("ticker", "date", *columns), ["ticker"], ["date"])
    # Piece 0 holds the first training rows, piece k the rows of step k.
    piece = F.when(F.col(R.POS) < start, F.lit(0)).otherwise(F.expr(f"({R.POS} - {start}) div {step} + 1"))
    rows = rows.withColumn("_piece", piece.cast("bigint")).withColumn(PART, F.expr(f"_piece div {STEPS}"))
    rows = materialize(centred(rows, columns).select("ticker", "date", R.POS, R.ROWS, "_piece", PART, *columns, f"_c_{target}"), "walk")
    before = _sums_before(gram(rows, ["ticker", PART], columns), PART).withColumnsRenamed({"ticker": "_t", PART: "_p"})
    d = len(columns) + 1

    def refit(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(R.POS)
        x = np.column_stack([np.ones(len(rows)), rows[columns].to_numpy(dtype=float)])
        first = int(key[1]) * STEPS
        ends = np.searchsorted(rows["_piece"].to_numpy(), np.arange(first, int(rows["_piece"].max()) + 2))
        own = np.array([x[a:b].T @ x[a:b] for a, b in zip(ends, ends[1:])])
        sums = square(before["cells"].iloc[0], d) + np.cumsum(own, axis=0) - own
        # Steps of the block that are whole and have rows before them.
        whole = [k for k in range(len(own)) if first + k > 0 and (first + k) * step + start <= rows[R.ROWS].iloc[0]]
        if not whole:
            return pd.DataFrame(columns=["ticker", "fold", "date", "pred", "actual"])
        mean, weights, middle = ridge_weights(sums[whole], strength)
        out = []
        for k, m, w, y in zip(whole, mean, weights, middle):
            part = rows.iloc[ends[k]:ends[k + 1]]
            shift = part[f"_c_{target}"]
            out.append(pd.DataFrame({"ticker": part["ticker"], "fold": first + k - 1, "date": part["date"],
                                     "pred": (x[ends[k]:ends[k + 1], 1:-1] - m) @ w + y + shift, "actual": part[target] + shift}))
        return pd.concat(out)

    return rows.groupBy("ticker", PART).cogroup(before.groupBy("_t", "_p")).applyInPandas(
        refit, "ticker string, fold bigint, date date, pred double, actual double")


# --- models over windows -----------------------------------------------------------------------

def _windows(values: np.ndarray, window: int) -> np.ndarray:
    """Rows (oldest first) of the last ``window`` rows, flattened, for each row that has them."""
    view = np.lib.stride_tricks.sliding_window_view(values, window, axis=0)  # ends x features x window
    return view.transpose(0, 2, 1).reshape(len(view), -1)


def sequence_ridge(frame: DataFrame, names: Sequence[str], target: str, window: int = 30, horizon: int = 1, strength: float = 1.0,
                   n_splits: int = S.N_SPLITS, block_rows: int | None = None) -> DataFrame:
    """Ridge over the last ``window`` rows of ``names`` (flattened, oldest first) that predicts ``target``
    in the next row, per expanding fold of the windows; predictions of the test windows by the date of
    their last row. ``horizon``: rows that must follow a window. Values must be complete.
    """
    names, columns = list(names), list(dict.fromkeys([*names, target]))
    block_rows = block_rows or max(WINDOW_ROWS, 16 * window)
    rows = centred(R.with_position(frame.select("ticker", "date", *columns), ["ticker"], ["date"]), columns)
    # The segment of a window by its place among the windows, of which there are fewer than rows.
    lost = window - 1 + horizon
    mine = rows.withColumns({R.POS: F.col(R.POS) - (window - 1), R.ROWS: F.col(R.ROWS) - lost})
    mine = mine.withColumn("_seg", F.when((F.col(R.POS) >= 0) & (F.col(R.POS) < F.col(R.ROWS)), splits.segment(n_splits)))
    mine = mine.withColumns({R.POS: F.col(R.POS) + (window - 1), R.ROWS: F.col(R.ROWS) + lost})

    # Blocks with the rows before and after them, so that every window lies whole in its own block.
    blocks = materialize(_with_edges(mine, target, window, block_rows).select(
        "ticker", PART, "date", R.POS, "_seg", "_home", "_next", *names, f"_c_{target}"), "window-blocks")
    d = window * len(names) + 2
    iu, ju = np.triu_indices(d)

    def inputs(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """Windows that end in the block, and their inputs."""
        pdf = pdf.sort_values(R.POS)
        if len(pdf) < window:
            return pdf.iloc[:0], np.empty((0, window * len(names)))
        x = _windows(pdf[names].to_numpy(dtype=float), window)
        ends = pdf.iloc[window - 1:]
        good = (ends["_home"] & ends["_seg"].notna() & ends["_next"].notna()).to_numpy()
        return ends[good], x[good]

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        ends, x = inputs(pdf)
        out = []
        for seg in np.unique(ends["_seg"].to_numpy(dtype=np.int64)):
            at = (ends["_seg"] == seg).to_numpy()
            z = np.column_stack([np.ones(at.sum()), x[at], ends["_next"].to_numpy(dtype=float)[at]])
            out.append(pd.DataFrame({"ticker": pdf["ticker"].iloc[0], "segment": seg, "i": iu.astype(np.int32), "j": ju.astype(np.int32),
                                     "s": (z.T @ z)[iu, ju]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["ticker", "segment", "i", "j", "s"])

    cells = blocks.groupBy("ticker", PART).applyInPandas(products, "ticker string, segment bigint, i int, j int, s double")
    sums = _sums_before(cells.groupBy("ticker", "segment", "i", "j").agg(F.sum("s").alias("s")), "segment").where("segment > 0")

    def solved(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                mean, weights, middle = ridge_weights(square(r.cells, d)[None], strength)
                out.append((r.ticker, r.segment, mean[0].tolist(), weights[0].tolist(), float(middle[0])))
            yield pd.DataFrame(out, columns=["_t", "segment", "mean", "weights", "middle"])

    models = materialize(sums.mapInPandas(solved, "_t string, segment bigint, mean array<double>, weights array<double>, middle double"), "window-models")
    needed = blocks.where("_home and _seg > 0").select("ticker", PART, "_seg").distinct().join(
        models, (F.col("ticker") == F.col("_t")) & (F.col("_seg") == F.col("segment"))).select(
        "_t", F.col(PART).alias("_p"), "segment", "mean", "weights", "middle")

    def predicted(key: tuple, rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            ends, x = inputs(rows)
            for m in models.itertuples():
                at = (ends["_seg"] == m.segment).to_numpy()
                part = ends[at]
                shift = part[f"_c_{target}"].to_numpy()
                out.append(pd.DataFrame({"ticker": part["ticker"], "fold": m.segment - 1, "date": part["date"],
                                         "pred": (x[at] - np.array(m.mean)) @ np.array(m.weights) + m.middle + shift, "actual": part["_next"] + shift}))
        return pd.concat(out) if out else pd.DataFrame(columns=["ticker", "fold", "date", "pred", "actual"])

    return blocks.groupBy("ticker", PART).cogroup(needed.groupBy("_t", "_p")).applyInPandas(
        predicted, "ticker string, fold bigint, date date, pred double, actual double")


def _with_edges(rows: DataFrame, target: str, window: int, block_rows: int) -> DataFrame:
    """Rows dealt to blocks of positions with the ``window - 1`` rows before each; ``_home`` marks a
    block's own rows, ``_next`` the target of the row after."""
    nexts = R.tiled(rows, ["ticker"], lambda t, w: t.withColumn("_next", F.lead(target).over(w)), lookahead=1, block_rows=block_rows)
    home = F.expr(f"{R.POS} div {block_rows}")
    inside = F.pmod(F.col(R.POS), F.lit(block_rows))
    after = F.when((inside >= block_rows - (window - 1)) & ((home + 1) * block_rows < F.col(R.ROWS)), home + 1)
    dealt = nexts.withColumn(PART, F.explode(F.array_compact(F.array(home, after))))
    return dealt.withColumn("_home", F.col(PART) == home)
