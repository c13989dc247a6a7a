"""Serving features of a day's bars from stored carries, without reading history.

The carry of a ticker is what its next feature row needs of the earlier ones (``streaming.online``): the
last returns, the last known prices and logarithms and the last time, some 1700 bytes. A day's job reads
its own bars and the carries and gives their feature rows and the new carries.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapework import schemas as S
from tapework.operators import columns
from tapework.session import materialize
from tapework.streaming import online

CARRY = T.StructType([T.StructField("ticker", T.StringType()), *online.STATE.fields])
_NAMES = online.feature_names()
_MADE = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType()), *[T.StructField(n, T.DoubleType()) for n in _NAMES],
                      T.StructField("carry", online.STATE)])


def _extended(key: tuple, carries: pd.DataFrame, bars: pd.DataFrame) -> pd.DataFrame:
    """Feature rows of a ticker's new bars; the last row has the carry that follows. A ticker without new
    bars keeps its carry in a row without a date."""
    history = online.History() if carries.empty else online.History(int(carries["last"].iloc[0]), *(
        np.array(carries[n].iloc[0], float) for n in online.ARRAYS))
    day = pd.to_datetime(bars["date"]).to_numpy("datetime64[D]").astype(np.int64)
    rows = bars.assign(_d=day).sort_values("_d", kind="stable")
    rows = rows[(rows["_d"] > history.last) & ~rows["_d"].duplicated(keep="last")]
    if rows.empty:
        if carries.empty:
            return pd.DataFrame(columns=_MADE.names)
        out = pd.DataFrame({"ticker": [carries["_t"].iloc[0]], "date": [None], **{n: [None] for n in _NAMES}})
    else:
        made = online.advance(history, rows["_d"].to_numpy(), rows[list(S.PRICES)].to_numpy(float))
        out = pd.DataFrame({"ticker": key[0], "date": rows["date"].to_numpy(), **{n: made[n] for n in _NAMES}})
    carry = {"last": history.last, **{n: getattr(history, n).tolist() for n in online.ARRAYS}}
    out["carry"] = [None] * (len(out) - 1) + [carry]
    return out


def extend(bars: DataFrame, carries: DataFrame, names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Feature rows of new bars, and the carries of all tickers after them. Bars that are not later than
    their ticker's carry are left out; of one date the last counts."""
    made = materialize(carries.withColumnRenamed("ticker", "_t").groupBy("_t").cogroup(bars.select("ticker", "date", *S.PRICES).groupBy("ticker")).applyInPandas(
        _extended, _MADE), "extended")
    rows = columns.project_features(made.where("date is not null"), list(names or S.training_features()))
    return rows, made.where("carry is not null").select("ticker", "carry.*")
