"""The row-wise operators on a stream: stateless, so batch and stream share one definition; and windowed counts of late readings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def transformed(stream: DataFrame, *steps: Callable[[Column], Column]) -> DataFrame:
    """`values` after each step, on a batch or a stream."""
    values = F.col("values")
    for step in steps:
        values = step(values)
    return stream.withColumn("values", values)


def readings(stream: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """start, event_type, n and mean of (ts, event_type, value) rows by event time; rows later than the watermark are left out."""
    w = F.window("ts", window)
    return stream.withWatermark("ts", watermark).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def run_available(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what there is into Parquet under path, exactly once by the checkpoint, and read it."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return SparkSession.active().read.schema(df.schema).parquet(path)
