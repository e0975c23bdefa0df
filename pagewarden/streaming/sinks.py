"""Sinks that a restart does not write twice: each micro-batch is merged into a state table under its own id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..statetable import StateTable


def upsert_stream(stream: DataFrame, state: StateTable, merge: Callable[[str], Column], order: list[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merge all rows that the stream has now into ``state``, then stop.

    Spark gives a micro-batch the same id when it runs it again, and the table knows the ids that it has
    merged, so a batch counts once though its commit was lost.  Spark lets only one query use a checkpoint at a time,
    so no two runs merge at once.  ``prepare`` turns a micro-batch into rows of the table.
    """

    def merge_batch(rows: DataFrame, batch_id: int) -> None:
        state.upsert(prepare(rows) if prepare else rows, batch_id, merge, order)

    return stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
