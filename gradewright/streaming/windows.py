"""Structured Streaming forms of the frame windows: each takes a batch or a stream with an event time `ts`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def _aggregates(keyed) -> DataFrame:
    return keyed.agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def timed(df: DataFrame) -> DataFrame:
    """df with `ts` as a timestamp: a watermark takes no timestamp without a zone (it is read in the session's zone)."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if isinstance(df.schema["ts"].dataType, TimestampNTZType) else df


def _late(df: DataFrame, delay: str) -> DataFrame:
    return timed(df).withWatermark("ts", delay) if df.isStreaming else df


def _flat(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def tumbling(df: DataFrame, keys: list[str], width: str, delay: str = "10 minutes") -> DataFrame:
    """Count and mean of fixed chunks; a stream closes a chunk once the watermark has passed it."""
    return _flat(_aggregates(_late(df, delay).groupBy(*keys, F.window("ts", width).alias("window"))), keys)


def sliding(df: DataFrame, keys: list[str], width: str, slide: str, delay: str = "10 minutes") -> DataFrame:
    return _flat(_aggregates(_late(df, delay).groupBy(*keys, F.window("ts", width, slide).alias("window"))), keys)


def sessions(df: DataFrame, keys: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    """A track ends where nothing is seen for `gap`."""
    return _flat(_aggregates(_late(df, delay).groupBy(*keys, F.session_window("ts", gap).alias("window"))), keys)


def once_by_key(df: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen before within the watermark: a re-run of the same work adds nothing."""
    return timed(df).withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
