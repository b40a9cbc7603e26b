"""Row transforms over streams of files.

Filters and projections of reads and intervals are row by row, so they run unchanged on a streaming
DataFrame; coverage and counts become windowed sums by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_table(spark: SparkSession, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def start(df: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Writes transform(df) to a folder as Parquet, once for each input row."""
    return transform(df).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window; events that come later than `late` are dropped
    by the watermark on a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
