"""Words that arrive as a stream go into the vocabulary batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vectide.operators.insertion import Indexes, Inserted, insert_batch


def insert_stream(terms: DataFrame, current: Callable[[], Indexes], apply: Callable[[Inserted, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that inserts each micro-batch of terms (term).

    current() reads the tables as the last batch has left them. apply(rows, batch) appends and replaces; it gets the
    batch's number, so that a batch that is sent again after a failure can be told from a new one.
    """

    def each(batch: DataFrame, number: int) -> None:
        apply(insert_batch(current(), batch), number)

    return terms.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
