"""Upkeep of tables that a query writes a folder per micro-batch to.

``compact`` writes the closed micro-batches as one table beside them and names it by the last of them;
the rename of that folder is the commit. Readers take the newest such table and the later batches, so
they see every row once, before, during and after. What a compaction has replaced is deleted by the one
after the next, when readers of that time have ended. The running query only touches later batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Newest batches that are left alone: a restarted query may write its last one again.
OPEN = 2
_MERGED = "_merged"  # Spark's readers pass over names that start with an underscore


class Sink:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.Path("/".join((self.path, *parts)))

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        at = self._at(folder) if folder else self._jvm.Path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())

    def batches(self) -> list[int]:
        return self._numbers("", "batch=")

    def merged(self) -> list[int]:
        """Last batches of the compacted tables that are there, oldest first."""
        return self._numbers(_MERGED, "upto=")

    def _parts(self, upto: int | None, batches: list[int]) -> DataFrame | None:
        read = [f"{self.path}/{_MERGED}/upto={upto}"] if upto is not None else []
        frames = [self.spark.read.parquet(p) for p in read]
        if batches:
            # One listing of the whole folder; batches are its partitions.
            rows = self.spark.read.parquet(self.path)
            frames.append(rows.where(F.col("batch").between(batches[0], batches[-1])).drop("batch"))
        if not frames:
            return None
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)

    def read(self) -> DataFrame:
        """All rows that retention has not dropped, each once."""
        upto = max(self.merged(), default=None)
        rows = self._parts(upto, [b for b in self.batches() if upto is None or b > upto])
        if rows is None:
            raise FileNotFoundError(f"nothing has been written to {self.path}")
        return rows

    def compact(self, keep: Column | None = None, open_batches: int = OPEN) -> int | None:
        """Merge the closed batches with what was merged before; of its rows only those stay for which
        ``keep`` holds. Returns the last merged batch, or None where there was nothing to do."""
        tables = self.merged()
        upto = max(tables, default=None)
        closed = [b for b in self.batches() if upto is None or b > upto]
        closed = closed[:-open_batches] if open_batches else closed
        if not closed:
            return None
        rows = self._parts(upto, closed)
        rows = rows.where(keep) if keep is not None else rows
        draft = f"{_MERGED}/_draft-{uuid.uuid4().hex}"
        rows.hint("rebalance").write.parquet(f"{self.path}/{draft}")
        if not self._fs.rename(self._at(draft), self._at(_MERGED, f"upto={closed[-1]}")):
            raise RuntimeError(f"{self.path} has been compacted by another job")
        # What the table before this one had replaced, and the tables before that one.
        for old in tables[:-1]:
            self._fs.delete(self._at(_MERGED, f"upto={old}"), True)
        for b in self.batches():
            if upto is not None and b <= upto:
                self._fs.delete(self._at(f"batch={b}"), True)
        return closed[-1]
