"""Helpers that the operators share: scratch tables, bounded broadcasts, Arrow batch sizes."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.arrow import ARROW_ROWS, small_batches, tidy  # noqa: F401
from pagewarden.operators.joins import dealt
from pagewarden.storage import discard, shared_dir  # noqa: F401
from pagewarden.storage import materialize as scratch  # noqa: F401

#: A side is broadcast only if it was counted and has no more rows and, at so many a row, no more bytes than this.
BROADCAST_ROWS, BROADCAST_BYTES, ROW_BYTES = 100_000, 32 << 20, 200
#: Tasks that one key of the other side is dealt over where a side is too large to be broadcast.
SALTS = 16


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int, size: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of so many rows and bytes for what is written inside; the session's own settings after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def is_small(rows: int, row_bytes: int = ROW_BYTES) -> bool:
    return rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES


def hint_small(df: DataFrame, rows: int, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Broadcast df if its counted rows, and their bytes, are under the bound; a shuffle join otherwise."""
    return F.broadcast(df) if is_small(rows, row_bytes) else df


def join_spread(big: DataFrame, small: DataFrame, on: list[str], salt: Column, rows: int, how: str = "inner", row_bytes: int = ROW_BYTES) -> DataFrame:
    """big joined with ``rows`` rows of small: broadcast if they are few, else each repeated SALTS times, so that no key of big is one task.

    ``salt`` is a column of big that differs among rows of one key.
    """
    if is_small(rows, row_bytes):
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS).cast("long"))).join(dealt(salted), [*on, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_unit(*cols) -> F.Column:
    """A number in [0, 1) that depends only on the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))
