"""Files as a stream: exact repeats are found as they arrive, with the state of a watermark's span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, time: str, span: str = "1 day") -> DataFrame:
    """Rows of a stream whose key has not been seen within the span."""
    return stream.withWatermark(time, span).dropDuplicatesWithinWatermark([key])


def repeat_counts(stream: DataFrame, key: str, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """How often each key arrives per window, late rows included up to ``late``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))
