"""Tables whose rows are changed by key, version by version, below one folder of a file system that Spark knows.

A version is written whole beside the others and takes effect by one rename, so a reader sees the old
or the new one.  Each version's folder is named by the batch that made it; ids of batches ascend, so a
batch that comes again, as after a restart, is known and changes nothing.  The last ``keep`` versions
stay for readers that have begun.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = re.compile(r"batch=(\d{12})")


class StateTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], keep: int = 2) -> None:
        self.spark, self.path, self.keys, self.keep = spark, path.rstrip("/"), keys, keep

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def versions(self) -> list[int]:
        """The batches whose versions are there, in order."""
        fs, where = self._fs(self.path)
        if not fs.exists(where):
            return []
        found = [_VERSION.fullmatch(s.getPath().getName()) for s in fs.listStatus(where)]
        return sorted(int(m[1]) for m in found if m)

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch:012d}"

    def read(self) -> DataFrame | None:
        """The newest version; None before the first."""
        known = self.versions()
        return self.spark.read.parquet(self._folder(known[-1])) if known else None

    def upsert(self, batch: DataFrame, batch_id: int, merge: Callable[[str], F.Column], order: list[str]) -> bool:
        """Merge a batch by key; False if it was merged before.

        Rows of one key in a batch count as one, the last by ``order``.  ``merge(column)`` is the new value of
        a column of old.column and new.column, either of which is null where the key is missing.
        Batches come one at a time.
        """
        known = self.versions()
        if known and batch_id <= known[-1]:
            return False
        rest = [c for c in batch.columns if c not in self.keys]
        latest = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*self.keys, "r.*")
        old = self.read()
        if old is None:
            old = latest.limit(0)
        same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in self.keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        both = old.alias("old").join(latest.alias("new"), on, "full")
        rows = both.select(*[F.coalesce(F.col(f"new.{k}"), F.col(f"old.{k}")).alias(k) for k in self.keys], *[merge(c).cast(batch.schema[c].dataType).alias(c) for c in rest])
        made = f"{self.path}/.{uuid.uuid4().hex}"
        rows.write.parquet(made)
        fs, where = self._fs(made)
        if not fs.rename(where, self._fs(self._folder(batch_id))[1]):
            raise OSError(f"batch {batch_id} of {self.path} could not be put in place")
        for n in known[: max(0, len(known) + 1 - self.keep)]:
            fs, where = self._fs(self._folder(n))
            fs.delete(where, True)
        return True


def newer(column: str, by: str) -> F.Column:
    """The value of the row with the later ``by``: that of the batch unless the table's is later."""
    return F.when(F.col(f"new.{by}").isNull() | (F.col(f"old.{by}") > F.col(f"new.{by}")), F.col(f"old.{column}")).otherwise(F.col(f"new.{column}"))
