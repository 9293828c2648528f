"""Incremental runs: new files through a checkpointed stream, each batch idempotent.

The file source remembers what it has read in its checkpoint, so a stopped or crashed query goes on where it was; a batch
that runs again writes the folder of its own id again, so nothing is stored twice. Repeated messages across batches are
dropped by the message store, whose merge is atomic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillmill.operators.message_dedup import MessageStore


def each_batch(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, f: Callable[[DataFrame], DataFrame], fmt: str = "parquet", every: str | None = None) -> StreamingQuery:
    """f over each batch of new files; available data once, or every so often with a processing-time trigger."""
    src = spark.readStream.schema(schema).format(fmt).load(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        f(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w = src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)).start()


def into_store(spark: SparkSession, path: str, schema: str, store: MessageStore, checkpoint: str) -> StreamingQuery:
    """Messages delivered at least once become a table with one row each. Merging a batch again changes nothing."""
    src = spark.readStream.schema(schema).parquet(path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.merge(batch)

    return src.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
