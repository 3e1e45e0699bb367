"""Streamed upsert: every micro-batch goes into the events table once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chronicle.operators.upsert import EventTable


def start(events: DataFrame, table: EventTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert a stream of events; a batch that is repeated after a failure changes nothing."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.add(batch)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
