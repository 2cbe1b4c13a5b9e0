"""An addition, not a counterpart: the reference has no streams.

Windowed counts of an event stream, with a watermark that bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", time_col: str = "ts", key_col: str = "event_type") -> DataFrame:
    """window_start, key, n; works on a stream (append mode) and on a table alike."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))  # watermarks take no zone-less times
    return timed.withWatermark(time_col, late).groupBy(F.window(time_col, size), key_col).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key_col, "n")
