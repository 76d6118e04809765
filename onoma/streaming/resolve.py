"""Resolution of a stream of queries: each micro-batch is one batch against a cached index.

Matching keeps no state between batches, so foreachBatch runs the same plan as for tables, and a
batch that is run again writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from onoma.operators.index import Index
from onoma.operators.matching import scan
from onoma.sources.staging import staged


def resolve_stream(queries: DataFrame, index: Index, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that gives sink(hits, batch_id) for each micro-batch of queries(qid, text, th, type); the caller starts it.

    sink must have read or written the hits when it returns: what the batch staged is deleted then.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        held = rows.persist()
        try:
            with staged(rows.sparkSession):  # the shared folder does not grow with the number of batches
                sink(scan(held, index), batch_id)
        finally:
            held.unpersist()

    return queries.writeStream.foreachBatch(batch)


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, so a repeated batch replaces itself."""

    def write(hits: DataFrame, batch_id: int) -> None:
        hits.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
