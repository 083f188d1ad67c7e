"""Windowed aggregates of a stream of observations, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def epoch_aggregates(observations: DataFrame, key: str, value: str, width: str = "3 days", late: str = "1 day") -> DataFrame:
    """``key, start, n, mean`` of each window of ``ts``. On a stream, state older than the watermark goes."""
    windows = observations.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), key)
    return windows.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(key, F.col("window.start").alias("start"), "n", "mean")


def follow(spark, path: str, schema: str, checkpoint: str, out: str, key: str, value: str, width: str = "3 days"):
    """Start the aggregates over Parquet files that appear in a folder; finished windows are appended to another."""
    stream = spark.readStream.schema(schema).parquet(path)
    return epoch_aggregates(stream, key, value, width).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").start(out)
