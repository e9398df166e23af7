"""Stored queries against a stream of documents: each micro-batch is matched like a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexspark.operators.inverse import percolate


def percolate_stream(documents: DataFrame, stored: DataFrame, words: Column, sink: Callable[[DataFrame, int], None], checkpoint: str, key: str = "doc_id", **trigger) -> StreamingQuery:
    """Starts a query that hands (key, query_id) of each micro-batch to ``sink`` with the batch's number.

    Stored queries are read anew for every batch, so changes to their table take effect. Offsets and batch numbers
    are kept in ``checkpoint``; a sink that writes by batch number is exact after a restart.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(percolate(batch, stored, words, key), number)

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
