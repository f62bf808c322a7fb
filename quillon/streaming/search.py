"""Answering a stream of queries: each micro-batch is searched as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillon.index import SparseIndex


def search_stream(index: SparseIndex, queries: DataFrame, path: str, checkpoint: str, k: int, trigger: dict | None = None, **options) -> StreamingQuery:
    """Writes results of a stream of (qid, term, weight) rows below path, a folder for each micro-batch; a batch done again overwrites its own."""

    def answer(batch: DataFrame, number: int) -> None:
        batch.persist()
        index.search(batch, k, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
