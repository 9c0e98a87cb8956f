"""Structured Streaming: exactly-once ingestion and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.session import Session


def drain(session: Session, stream: DataFrame, dataset: str, checkpoint: str, upsert: bool = False, available_now: bool = True) -> StreamingQuery:
    """Write every micro-batch of ``stream`` to a managed dataset as one write; its views follow.

    The stream's last batch number is committed with the data, so a batch that is run again after a failure
    changes nothing, however long ago it was.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                session.append(dataset, batch, stream=(checkpoint, number), upsert=upsert)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per window of event time and key; events later than ``late`` behind the newest are left out on streams."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark(time, late)
    return timed.groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
