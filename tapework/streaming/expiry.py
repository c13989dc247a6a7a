"""Latest values that expire by themselves.

State holds one value per slot. Each value sets a timer at its time plus the slot's time to live; when
the watermark passes it, the slot is dropped from the state and a row says so. A micro-batch is read a
chunk at a time and leaves one value, so a hot slot costs one row of memory however many messages it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapework.streaming import candles

SLOT = ("ticker", "period", "interval")
_STATE = T.StructType([T.StructField("ts", T.LongType()), T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
                       T.StructField("offset", T.LongType()), T.StructField("close", T.DoubleType())])
_OUT = T.StructType([*[T.StructField(c, T.StringType()) for c in SLOT], T.StructField("ts", T.TimestampType()),
                     T.StructField("close", T.DoubleType()), T.StructField("offset", T.LongType()), T.StructField("expired", T.BooleanType())])


def _newest(part: pd.DataFrame, best: tuple | None) -> tuple | None:
    """The latest of a chunk's messages and of what was there, by time, topic, partition and offset."""
    if not len(part):
        return best
    row = part.sort_values(["ts", "topic", "partition", "offset"], kind="stable").iloc[-1]
    found = (int(row["ts"].value // 1_000_000), str(row["topic"]), int(row["partition"]), int(row["offset"]), float(row["close"]))
    return found if best is None or found[:4] > best[:4] else best


def _kept(seconds: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(value: tuple, expired: bool) -> pd.DataFrame:
            return pd.DataFrame([(*key, pd.Timestamp(value[0], unit="ms"), value[4], value[3], expired)], columns=_OUT.names)

        old = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield row(old, True)
            return
        best = old
        for part in parts:
            best = _newest(part, best)
        if best is None or best == old:
            return
        ends = best[0] + seconds * 1000
        if ends <= state.getCurrentWatermarkMs():  # it came when it had expired already
            if old is not None:
                state.remove()
                yield row(old, True)
            return
        state.update(best)
        state.setTimeoutTimestamp(ends)
        yield row(best, False)
    return run


def expiring(timed: DataFrame, seconds: int = candles.LATEST_TTL, lateness: str = "0 seconds") -> DataFrame:
    """Changes of slots, on a stream: a row per micro-batch with a slot's new value, and one with
    ``expired`` when ``seconds`` have passed after its time without another. Expiry follows the times in
    the messages, of which ``lateness`` is how late one may come."""
    rows = timed.withWatermark("ts", lateness).select(*SLOT, "ts", "topic", "partition", "offset", "close")
    return rows.groupBy(*SLOT).applyInPandasWithState(_kept(seconds), _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def keep_changes(timed: DataFrame, path: str, checkpoint: str, seconds: int = candles.LATEST_TTL, lateness: str = "0 seconds",
                 mode: str | None = None) -> StreamingQuery:
    """The changes of all slots, a folder per micro-batch (``upkeep.Sink`` reads and compacts them)."""
    writer = expiring(timed, seconds, lateness).writeStream.outputMode("update").foreachBatch(
        lambda b, n: candles._replace_batch(b, path, n)).option("checkpointLocation", checkpoint)
    return candles.cadence(writer, mode).start()


def alive(changes: DataFrame, keys: Sequence[str] = SLOT) -> DataFrame:
    """Slots that hold a value after all changes; a slot's expiry comes after the value it ends."""
    last = F.max_by(F.struct("ts", "close", "offset", "expired"), F.struct("ts", "offset", "expired"))
    return changes.groupBy(*keys).agg(last.alias("m")).select(*keys, "m.*").where(~F.col("expired")).drop("expired")
