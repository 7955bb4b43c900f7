"""An extension beyond the batch operators: event counts by window as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, time_column: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """window_start, by, n, total: works on batches and, with its watermark, on streams in append mode."""
    base = events.withWatermark(time_column, late) if events.isStreaming else events
    grouped = base.groupBy(F.window(time_column, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), by, "n", F.round("total", 6).alias("total"))
