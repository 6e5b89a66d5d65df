"""Pixel files that arrive in a folder, counted by class as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators.classify import class_counts


def watch(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Rows of Parquet files that arrive in ``folder``, each file once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def count_classes(painted: DataFrame, keys: list[str]) -> DataFrame:
    """Running class counts by ``keys``; their state is a row for each key."""
    return class_counts(painted, keys)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Events in windows of time, with rows later than ``late`` behind the newest dropped, which bounds the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what there is, and stops; the next run goes on from there."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
