"""Structured streaming over events, an extension: windowed counts with late data, and batches upserted into the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ledger import Ledger, Spec

#: The table that windows are kept in.
WINDOWS = {"event_windows": Spec("window_start timestamp, event_type string, n long, total double", ("window_start", "event_type"), "window_start")}


def windowed(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``window_start, event_type, n, total``; the same for a table and for a stream, whose watermark is ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    rows = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def upserting(ledger: Ledger, table: str, stream: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch of ``stream`` is one commit that upserts it into ``table``.

    The commit has the batch's number, so a batch that the engine runs once more after a failure changes nothing.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()  # it is read for its months and for its rows
        try:
            ledger.commit({table: batch}, batch=(stream, number))
        finally:
            batch.unpersist()

    return save


def keep_windows(events: DataFrame, ledger: Ledger, checkpoint: str, size: str = "1 hour", late: str = "1 day", once: bool = True) -> StreamingQuery:
    """Starts the stream ``events`` into the ledger's table event_windows: windows that a batch changes are upserted.

    State (open windows, the watermark, what is read) lies in the folder ``checkpoint``; a stream that is started again
    on it goes on where the last one ended. ``once``: it ends when all that is there is read.
    """
    writer = windowed(events, size, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(upserting(ledger, "event_windows", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()
