"""Per-instrument forecasts, fitted for every (ticker, fold) in the same jobs.

Expanding folds share training rows, so linear models are fitted from sums per (ticker, segment)
that are accumulated along the segments. No training set is copied per fold and none is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapework import schemas as S
from tapework.functions import metrics as M
from tapework.operators import features, joins, splits
from tapework.operators import series as R
from tapework.operators.stats import gram, square

KEYS = ["ticker", "fold"]


def lag_frame(bars: DataFrame, horizon: int = S.HORIZON) -> DataFrame:
    """One lagged return and the target: ``ticker, date, x, y``."""
    def build(rows, w):
        rows = features.with_log_returns(rows, w, ["close"])
        return rows.select("*", F.lag("close_log_return").over(w).alias("x"),
                           F.lead("close_log_return", horizon).over(w).alias("y"))
    frame = R.tiled(features.positioned(bars.select("ticker", "date", "close")), ["ticker"], build,
                    lookback=2, lookahead=horizon)
    return frame.select("ticker", "date", "x", "y").na.drop()


_SUMS = ("n", "sx", "sy", "sxx", "sxy")


def _pair_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))


def centred(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean over the ticker, which goes to ``_c_{column}``. Sums of squares and
    products then keep their digits; lines and spreads do not depend on the shift."""
    means = rows.groupBy("ticker").agg(*[F.avg(c).alias(f"_c_{c}") for c in columns])
    return rows.join(means, "ticker").withColumns({c: F.col(c) - F.col(f"_c_{c}") for c in columns})


def _line(n="n", sx="sx", sy="sy", sxx="sxx", sxy="sxy") -> tuple[Column, Column]:
    n, sx, sy, sxx, sxy = map(F.col, (n, sx, sy, sxx, sxy))
    slope = (sxy - sx * sy / n) / F.nullif(sxx - sx * sx / n, F.lit(0.0))
    return slope, (sy - slope * sx) / n


def ols1_forecast(frame: DataFrame, n_splits: int = S.N_SPLITS) -> DataFrame:
    """Least-squares line of ``y`` on ``x``, per expanding fold, applied to its test rows."""
    rows = centred(splits.with_segments(frame, n_splits=n_splits), ["x", "y"])
    earlier = Window.partitionBy("ticker").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = _pair_sums(rows, ["ticker", "segment"]).select(
        "ticker", "segment", *[F.sum(c).over(earlier).alias(c) for c in _SUMS])
    slope, intercept = _line()
    lines = sums.where("segment > 0").select("ticker", (F.col("segment") - 1).alias("fold"),
                                             slope.alias("slope"), intercept.alias("intercept"))
    return (splits.test_rows(rows, n_splits).join(lines, KEYS)
            .select(*KEYS, "date", (F.col("slope") * F.col("x") + F.col("intercept") + F.col("_c_y")).alias("pred"),
                    (F.col("y") + F.col("_c_y")).alias("actual"), R.POS, R.ROWS))


def walk_forward_forecast(frame: DataFrame, start: int = S.LOOKBACK, step: int = S.WALK_STEP) -> DataFrame:
    """Line refitted before every step on all earlier rows, from running sums over the steps."""
    rows = centred(R.with_position(frame, ["ticker"], ["date"]), ["x", "y"])
    # Piece 0 holds the first training rows, piece k the rows of step k.
    pieces = rows.withColumn("piece", F.greatest(F.expr(f"({R.POS} - {start}) div {step} + 1"), F.lit(0)))
    pieces = pieces.withColumn("piece", F.when(F.col(R.POS) < start, F.lit(0)).otherwise(F.col("piece")))
    sums = _pair_sums(pieces, ["ticker", "piece"]).withColumn(R.POS, F.col("piece")).withColumn(R.ROWS, F.lit(0))
    totals = R.running(sums, ["ticker"], {f"t_{c}": ("sum", c) for c in _SUMS})
    slope, intercept = _line(*[f"t_{c}" for c in _SUMS])
    lines = totals.select("ticker", F.col("piece").alias("fold"), slope.alias("slope"), intercept.alias("intercept"))
    test = (pieces.where(F.col("piece") > 0).withColumn("fold", F.col("piece") - 1)
            .where((F.col("fold") + 1) * step + start <= F.col(R.ROWS)))
    return test.join(lines, KEYS).select(
        *KEYS, "date", (F.col("slope") * F.col("x") + F.col("intercept") + F.col("_c_y")).alias("pred"),
        (F.col("y") + F.col("_c_y")).alias("actual"), (F.col(R.POS) - start - F.col("fold") * step).alias(R.POS), F.lit(step).cast("bigint").alias(R.ROWS))


def train_stats(segmented: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each fold's training rows, from merged segment moments."""
    per = segmented.groupBy("ticker", "segment").agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.var_pop(c).alias(f"_v_{c}") for c in columns])
    earlier = Window.partitionBy("ticker").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    # A fold merges a handful of segments. Deviations are taken from the merged mean, so large values
    # with a small spread lose no digits.
    merged = per.select("ticker", "segment", F.collect_list(F.struct("_n", *[f"_{k}_{c}" for c in columns for k in "mv"])).over(earlier).alias("_s"))

    def total(value) -> Column:
        return F.aggregate(F.transform("_s", value), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    n = F.nullif(total(lambda s: s["_n"]), F.lit(0.0))
    merged = merged.withColumns({f"{c}_mean": total(_sum_of(c)) / n for c in columns})
    spread = {f"{c}_std": F.sqrt(total(_about(c)) / n) for c in columns}
    return merged.withColumns(spread).where("segment > 0").withColumn("fold", F.col("segment") - 1).drop("segment", "_s")


def _sum_of(c: str) -> Callable[[Column], Column]:
    return lambda s: s["_n"] * s[f"_m_{c}"]


def _about(c: str) -> Callable[[Column], Column]:
    """Squared deviations of a segment from the merged mean."""
    return lambda s: s["_n"] * (s[f"_v_{c}"] + (s[f"_m_{c}"] - F.col(f"{c}_mean")) * (s[f"_m_{c}"] - F.col(f"{c}_mean")))


def standardize(frame: DataFrame, columns: Sequence[str], n_splits: int = S.N_SPLITS) -> DataFrame:
    """Test rows scaled by their fold's training rows (a constant column keeps its spread of 1)."""
    rows = splits.with_segments(frame, n_splits=n_splits)
    scaled = splits.test_rows(rows, n_splits).join(train_stats(rows, columns), KEYS)
    return scaled.select(*KEYS, "date", *[
        ((F.col(c) - F.col(f"{c}_mean")) / F.coalesce(F.nullif(F.col(f"{c}_std"), F.lit(0.0)), F.lit(1.0))).alias(c)
        for c in columns])


def invert_scale(scaled: DataFrame, stats: DataFrame, column: str) -> DataFrame:
    """Values back in their own units."""
    std = F.coalesce(F.nullif(F.col(f"{column}_std"), F.lit(0.0)), F.lit(1.0))
    return scaled.join(stats, KEYS).select(
        *scaled.columns, (F.col(column) * std + F.col(f"{column}_mean")).alias(f"{column}_original"))


def ridge_models(frame: DataFrame, names: Sequence[str], target: str = "target", strengths: Sequence[float] = (1.0,),
                 n_splits: int = S.N_SPLITS) -> DataFrame:
    """Ridge weights on standardised features for each fold and strength.

    One pass forms cross products per (ticker, segment); they are accumulated along the segments,
    and a small system is solved per (ticker, fold) for all strengths at once.
    """
    rows = frame if "segment" in frame.columns else splits.with_segments(frame, n_splits=n_splits)
    columns = [*names, target]
    # Cross products of values less the ticker's means keep their digits; the means are added back.
    rows = centred(rows.select("ticker", "segment", *columns), columns)
    shifts = rows.groupBy("ticker").agg(F.array(*[F.first(f"_c_{c}") for c in columns]).alias("shift"))
    rows = rows.select("ticker", "segment", *columns)
    earlier = Window.partitionBy("ticker", "i", "j").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    cells = (gram(rows, ["ticker", "segment"], columns)
             .select("ticker", "segment", "i", "j", F.sum("s").over(earlier).alias("s")).where("segment > 0")
             .groupBy("ticker", (F.col("segment") - 1).alias("fold"))
             .agg(F.collect_list(F.struct("i", "j", "s")).alias("cells")).join(shifts, "ticker"))
    d, strengths = len(columns) + 1, [float(s) for s in strengths]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                m = square(row.cells, d)
                n, mean = m[0, 0], m[0, 1:] / m[0, 0]
                cov = m[1:, 1:] / n - np.outer(mean, mean)
                scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
                scale[scale == 0] = 1.0
                a, b = n * cov[:-1, :-1] / np.outer(scale, scale), n * cov[:-1, -1] / scale
                mean = mean + np.asarray(row.shift, dtype=float)
                for k, s in enumerate(strengths):
                    w = np.linalg.solve(a + s * np.eye(len(b)), b)
                    out.append((row.ticker, row.fold, k, s, mean[:-1].tolist(), scale.tolist(), w.tolist(), mean[-1]))
            yield pd.DataFrame(out, columns=["ticker", "fold", "trial", "strength", "mean", "scale", "weights",
                                             "intercept"])

    return cells.mapInPandas(solve, "ticker string, fold bigint, trial int, strength double, mean array<double>, "
                                    "scale array<double>, weights array<double>, intercept double")


def ridge_forecast(frame: DataFrame, names: Sequence[str], target: str = "target", strength: float = 1.0,
                   n_splits: int = S.N_SPLITS) -> DataFrame:
    rows = splits.with_segments(frame, n_splits=n_splits)
    models = ridge_models(rows, names, target, [strength])
    return joins.score_join(splits.test_rows(rows, n_splits), models, names, KEYS).select(
        *KEYS, "date", "pred", F.col(target).alias("actual"), R.POS, R.ROWS)


def trial_losses(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Errors and the composite loss per key."""
    measured = preds.groupBy(*keys).agg(
        M.mae().alias("mae"), M.rmse().alias("rmse"), M.mape().alias("mape"), M.r2().alias("r2"),
        F.avg(F.abs("actual")).alias("mean_abs"))
    return measured.withColumn("loss", M.composite_loss(
        F.col("mape"), F.col("r2"), F.col("mae"), F.col("mean_abs")))


def param_sweep(frame: DataFrame, names: Sequence[str], strengths: Sequence[float], target: str = "target",
                n_splits: int = S.N_SPLITS) -> DataFrame:
    """Composite loss of every ridge strength for every fold; all strengths share one pass."""
    rows = splits.with_segments(frame, n_splits=n_splits)
    models = ridge_models(rows, names, target, strengths)
    scored = joins.score_join(splits.test_rows(rows, n_splits), models, names, KEYS, extra=["trial", "strength"])
    return trial_losses(scored.withColumn("actual", F.col(target)), [*KEYS, "trial", "strength"])


def shrinkage_trials(preds: DataFrame, factors: Sequence[float]) -> DataFrame:
    """Losses of scaled-down predictions: a small search space over an existing forecast."""
    trials = F.array(*[F.struct(F.lit(k).alias("trial"), F.lit(float(f)).alias("factor"))
                       for k, f in enumerate(factors)])
    tried = preds.select(*KEYS, "actual", F.col("pred").alias("_p"), F.inline(trials))
    return trial_losses(tried.withColumn("pred", F.col("_p") * F.col("factor")), [*KEYS, "trial", "factor"])


def config_or_default(folds: DataFrame, tuned: DataFrame, default: dict) -> DataFrame:
    """Tuned settings where a search gave any, defaults elsewhere."""
    return folds.join(tuned, KEYS, "left").select(
        *KEYS, *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in default.items()],
        F.coalesce(*[F.col(k) for k in default]).isNotNull().alias("tuned"))


def run_log(folds: DataFrame, run_id: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Numeric results of a run as ``run_id, ticker, fold, key, value`` rows."""
    names = [f.name for f in folds.schema if f.dataType.simpleString() == "double"]
    return folds.unpivot(list(keys), names, "key", "value").withColumn("run_id", F.lit(run_id))


def read_run_log(log: DataFrame, names: Sequence[str]) -> DataFrame:
    return log.groupBy("run_id", *KEYS).pivot("key", list(names)).agg(F.max("value"))


_LOADED: dict = {}


def loaded_score(rows: DataFrame, features: Sequence[str], load: Callable[[str], Callable[[np.ndarray], np.ndarray]],
                 key: str = "ticker", output: str = "pred") -> DataFrame:
    """Scores of models that are not linear: ``load(key)`` returns a function of a feature matrix.

    Rows are scored in Arrow batches where they lie; a worker loads the model of a key once and
    keeps it for its later batches.
    """
    features = list(features)
    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.full(len(pdf), np.nan)
            for name, part in pdf.groupby(key).indices.items():
                if (load, name) not in _LOADED:
                    _LOADED[(load, name)] = load(name)
                out[part] = _LOADED[(load, name)](pdf[features].to_numpy(dtype=float)[part])
            yield pdf.assign(**{output: out})

    return rows.mapInPandas(score, schema)


@dataclass(frozen=True)
class OnnxModels:
    """Loads ``{folder}/{ticker}/model.onnx`` from a file system every worker mounts.

    Two loaders of one folder are equal, so a worker's models outlive the task that loaded them.
    """

    folder: str

    def __call__(self, ticker: str) -> Callable[[np.ndarray], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(f"{self.folder}/{ticker}/model.onnx")
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x.astype(np.float32)})[0].reshape(len(x), -1)[:, 0]
