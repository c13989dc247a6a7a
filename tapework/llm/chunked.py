"""Corpora in chunks with dictionaries of their own.

An operator that needs a corpus-wide count for every token of every text would shuffle a row per token.
Here a task cuts its documents into chunks of bounded text, names each distinct key of a chunk once and
keeps the documents as positions in that list. Only (chunk, key) rows are shuffled: to the key for its
total, and back to the chunk with the answer. A key is at most once in a chunk, so no key is hot beyond
the number of chunks, and the join may be split by adaptive execution.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text in a chunk; a longer document is a chunk by itself.
CHUNK = 8 << 20


def packed(values: np.ndarray) -> bytes:
    """Small whole numbers as compressed bytes."""
    return zlib.compress(np.ascontiguousarray(values, np.int32).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int32)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    """Where consecutive runs of these sizes start, and the end of the last one."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def run_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``; empty runs give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[i] .. first[i] + size[i] - 1`` of all i, one after another."""
    starts = starts_of(size)
    return np.arange(starts[-1]) - np.repeat(starts[:-1] - first, size)


def cut(batches: Iterable[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[int, dict[str, list], pa.Schema]]:
    """(chunk number, columns, their types) of the documents of a task, by the characters of their ``_text``."""
    number = TaskContext.get().partitionId() << 32
    held: dict[str, list] = {}
    chars = 0
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            for name, value in zip(names, row):
                held.setdefault(name, []).append(value)
            chars += len(held["_text"][-1] or "")
            if chars >= size:
                yield number, held, batch.schema
                number, held, chars = number + 1, {}, 0
    if held:
        yield number, held, batch.schema


def entries(chunks: DataFrame) -> DataFrame:
    """``(chunk, at, key, n)``: the dictionaries of chunks, whose rows have ``keys`` and ``seen``."""
    return chunks.where(F.col("keys").isNotNull()).select("chunk", F.posexplode(F.arrays_zip("keys", "seen"))).select(
        "chunk", F.col("pos").alias("at"), F.col("col.keys").alias("key"), F.col("col.seen").alias("n"))
