"""The event chain over a stream: how often one event type comes in each window, an extension beside the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(ts, event_type) of a stream or a table -> start, event_type, n by tumbling windows; later events are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")
