"""Queries that arrive as a stream, answered from a fitted index (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vicinal.operators import search
from vicinal.operators.index import ApproxKNN


def answer_stream(knn: ApproxKNN, queries: DataFrame, sink: Callable[[DataFrame, int], None], k: int | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Starts a query that searches the index for every micro-batch of (id, vec) rows.

    The sink gets (query_id, rank, neighbor_id, distance) and the batch's
    number; with an idempotent sink and a checkpoint each query is answered once.
    """
    index = knn.index

    def each(batch: DataFrame, number: int) -> None:
        signed = index.signed(batch.select("id", "vec"))
        sizes = (index.total_size, batch.count(), index.dims)
        sink(search.search(index.members(), index.keyed(signed), k or knn.k, False, index.options.num_hash_tables, sizes), number)

    writer = queries.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
