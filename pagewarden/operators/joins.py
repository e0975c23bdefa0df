"""Joins of tables that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that deals both sides over the tasks.

    Spark plans by the size of compressed files and takes no account of rows that an array is exploded to, so it would
    broadcast, through the driver, sides that are many times larger than they look.
    """
    return df.hint("merge")


#: Bits of a filter that is broadcast: at most 262 144 rows of 64, whatever the keys' number.
FILTER_BITS = 1 << 24


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose columns ``on`` are in keys; rows that a filter of bounded size tells are none of them do not move."""
    place = lambda c: c.withColumn("_p", F.pmod(F.xxhash64(*[F.col(x).cast("string") for x in on]), F.lit(FILTER_BITS)))
    bits = place(keys).groupBy(F.expr("_p DIV 64").alias("_at")).agg(F.expr("bit_or(shiftleft(1L, CAST(_p % 64 AS INT)))").alias("_bits"))
    kept = place(rows).withColumn("_at", F.expr("_p DIV 64")).join(F.broadcast(bits), "_at").where("shiftrightunsigned(_bits, CAST(_p % 64 AS INT)) & 1 = 1")
    # No semi join: that would be moved below the filter.
    return kept.drop("_p", "_at", "_bits").join(keys.select(*on).distinct(), on).select(*rows.columns)
