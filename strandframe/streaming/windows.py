"""Event-time windows over an event stream: an extension, not a feature of the reference.

The functions work on batch and streaming tables alike; a streaming one needs the watermark, which bounds its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str, late: str = "10 minutes", time: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(start, keys, n, total) per window; events later than `late` are dropped by the stream's watermark."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, finish, n): runs of events of a key with less than `gap` between them."""
    w = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")
