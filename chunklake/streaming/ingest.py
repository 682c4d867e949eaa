"""Streaming ingestion: each micro-batch is one append and one flush; a batch that is delivered again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chunklake.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, maintain: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that writes a stream of rows (x, z, type_id, payload, order) to the store.

    The batch number is kept in the store's pointer together with the data, so a restart from the checkpoint writes each batch
    once. Every ``stable_flushes`` flushes the store is maintained.
    """

    def batch(rows: DataFrame, number: int) -> None:
        # rows, batch number and flush are one commit; maintenance that a crash cut short is due at the next batch
        store.write(rows, batch=number, flush=True)
        state = store.state()
        if maintain and state["flushes"] - state["maintained"] >= max(1, store.config.stable_flushes):
            store.maintain()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def region_activity(stream: DataFrame, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Writes for each region and epoch (an event-time window of ``ts``), late rows within ``delay`` included."""
    from pyspark.sql import functions as F

    from chunklake.operators.latest import region_project

    return region_project(stream).withWatermark("ts", delay).groupBy(F.window("ts", window), "rx", "rz").agg(F.count(F.lit(1)).alias("writes"))
