"""History upsert and snapshot append as sinks of a stream of landed files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from quantframe.sources.history import append_snapshot, upsert_history
from quantframe.sources.upsert_log import UpsertLog

Batch = Callable[[DataFrame, int], None]


def upsert_batches(path: str, fetched_at: Column | None = None, **options) -> Batch:
    """Function for ``foreachBatch`` that merges each micro-batch; ``options`` go to ``upsert_history``.
    Merging the same batch twice changes nothing, so a restart after a failure is safe."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert_history(batch, path, fetched_at=fetched_at, **options)
    return merge


def log_batches(path: str, key: Sequence[str], order_by: Sequence[str] = (), metadata: Mapping[str, object] | None = None,
                fetched_at: Column | None = None, stream: str = "") -> Batch:
    """Function for ``foreachBatch`` that merges each micro-batch into an ``UpsertLog``: a batch is merged once, however
    often it is handed in and wherever a run before was cut off."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        UpsertLog(batch.sparkSession, path, key, order_by).merge(batch, metadata, fetched_at, stream, batch_id)
    return merge


def snapshot_batches(path: str, metadata: Mapping[str, object] | None = None,
                     fetched_at: Column | None = None) -> Batch:
    """Function for ``foreachBatch`` that appends each micro-batch once, also when it is replayed."""
    def append(batch: DataFrame, batch_id: int) -> None:
        append_snapshot(batch, path, metadata, fetched_at, batch_id)
    return append


def run_available(stream: DataFrame, batch: Batch, checkpoint: str) -> StreamingQuery:
    """Process everything that has landed since the last run, then stop."""
    query = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
