"""Streams into fragments: windowed sums with a watermark, and the array form of finished windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, key: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """key, start, n, total per window and key, for streams and tables; rows later than ``late`` are dropped by a stream."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(time, length).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("w.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, time: str, key: str, value: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start, end, n, total per run of events without a pause of ``gap``."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window(time, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
