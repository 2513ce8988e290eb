"""Structured Streaming front of the resumable caches: new rows are processed once by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.sources.sinks import append_missing


def append_new(stream: DataFrame, sink: str, keys: list[str], checkpoint: str, process: Callable[[DataFrame], DataFrame]) -> None:
    """Run what is available: each micro-batch appends the rows whose keys the sink lacks.

    The anti-join against the sink makes a repeated batch harmless, so delivery is effectively once.
    """

    def step(batch: DataFrame, _: int) -> None:
        append_missing(batch, sink, keys, process)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts and sums by tumbling window and key of a stream or a table; late rows beyond the watermark are dropped by streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")
