"""Windows over event time: an extension beyond the dialect, in batch and as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(df: DataFrame, window: Column, *keys: str, value: str = "value") -> DataFrame:
    """(start, end, keys, n, total) of windows; with ``F.window`` or ``F.session_window`` over a timestamp."""
    out = df.groupBy(window.alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "n", "total")


def late_tolerant(stream: DataFrame, ts: str, delay: str, size: str, *keys: str, value: str = "value") -> DataFrame:
    """Tumbling sums of a stream that wait ``delay`` for late rows and drop later ones; state is bounded by the delay."""
    return windowed(stream.withWatermark(ts, delay), F.window(ts, size), *keys, value=value)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows to a Parquet table, exactly once, for all data there is now."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
