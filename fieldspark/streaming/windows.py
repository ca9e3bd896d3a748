"""Event-time windows on streams and batches. On a stream a watermark bounds the state: rows later than ``LATE`` are dropped there, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LATE = "1 day"


def timed(df: DataFrame, column: str = "ts") -> DataFrame:
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, LATE) if df.isStreaming else out


def tumbling(df: DataFrame, width: str, keys: list[str], value: str, column: str = "ts") -> DataFrame:
    return timed(df, column).groupBy(F.window(column, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, gap: str, key: str, column: str = "ts") -> DataFrame:
    return timed(df, column).groupBy(F.session_window(column, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def deduplicated(df: DataFrame, keys: list[str], column: str = "ts") -> DataFrame:
    """A row of each key. A stream forgets a key once the watermark has passed it by ``LATE``, so it may come again after that; a batch keeps one row."""
    out = timed(df, column)
    return out.dropDuplicatesWithinWatermark(keys) if df.isStreaming else out.dropDuplicates(keys)
