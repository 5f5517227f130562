"""The event log as a stream: state per key, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def folded(events: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Last state per key, for output mode update or complete."""
    return events.groupBy(key).agg(F.max_by(status, order).alias("state"), F.count("*").alias("events"))


def windowed(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n"))


def run_once(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """All that is there, into a memory table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
