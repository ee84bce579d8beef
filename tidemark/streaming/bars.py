"""Session bars and rule checks of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bars(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(event_type, bar, open, high, low, close, volume) of a stream or table of events (ts timestamp, event_id, event_type, value).

    Rows later than the watermark are dropped by a stream; state is one buffer a type and open window.
    """
    place = F.struct("ts", "event_id")
    by = events.withWatermark("ts", late) if events.isStreaming else events
    out = by.groupBy("event_type", F.window("ts", length).alias("w")).agg(
        F.min_by("value", place).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", place).alias("close"), F.count("*").alias("volume")
    )
    return out.select("event_type", F.col("w.start").alias("bar"), "open", "high", "low", "close", "volume")
