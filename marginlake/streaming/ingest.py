"""Streaming order ingest into the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marginlake.streaming.changelog import write_batch


def ingest_orders(
    stream: DataFrame, root: str, checkpoint: str, *, source: str = "stream", once: bool = True
) -> StreamingQuery:
    """Validate, quarantine and land each micro-batch; safe to replay.

    ``stream`` is an order feed (text or typed columns) with the long column
    ``_seq`` that orders its rows. ``once`` drains what is there and stops.
    """
    writer = (
        stream.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, root, source))
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
