"""What runs write: class rasters, reports, and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_classified(painted: DataFrame, path: str, by: str = "image_id") -> None:
    """Class rasters as Parquet, a folder for each image, blocks together in files."""
    painted.repartition(by, "block").sortWithinPartitions(by, "block", "x", "y").write.mode("overwrite").partitionBy(by).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def append_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").option("header", True).csv(path)


def write_training_set(rows: DataFrame, path: str) -> None:
    """Replaces the label sets that ``rows`` holds, and leaves others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label_set").parquet(path)


def upsert_scene_stats(current: DataFrame, counts: DataFrame, key: str = "name") -> DataFrame:
    """Scene statistics (area and shares of classes) with those of ``counts`` (key, n1 to n5) in place."""
    area = sum((F.col(f"n{k}") for k in range(2, 6)), F.col("n1")) + 1
    fresh = counts.select(key, area.alias("area"), *((F.col(f"n{k}") / area).alias(n) for k, n in enumerate(("snow", "gray", "melt", "water"), 1)))
    return current.join(fresh.select(key), key, "left_anti").unionByName(fresh)
