"""Dimension tables and schemas: surface classes, sensors, and what their pixels and segments are called."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Class codes, names and display colours (red, green, blue).
CLASSES = (
    (0, "empty", 0.1, 0.1, 0.1),
    (1, "snow", 0.9, 0.9, 0.9),
    (2, "gray", 0.5, 0.5, 0.5),
    (3, "melt", 0.31, 0.431, 0.647),
    (4, "water", 0.31, 0.431, 0.647),
    (5, "shadow", 0.0, 0.0, 0.0),
    (6, "unknown", 0.27, 0.15, 0.5),
)

#: Columns of the per-image report, in order of the class codes 1 to 5.
REPORT_COLUMNS = ("White Ice", "Gray Ice", "Melt Ponds", "Open Water", "Shadow")


@dataclass(frozen=True)
class Sensor:
    """What segmentation of a sensor's scenes needs: thresholds in 8-bit gradient units, smoothing, spacing of seeds, bands."""

    bands: int
    low: float
    high: float
    sigma: float
    spacing: int
    edge_band: int
    gradient_band: int


# Segmentation parameters by sensor.
SENSORS = {
    "pan": Sensor(1, 0.05 * 255, 0.15 * 255, 1.0, 1, 0, 0),
    "wv02_ms": Sensor(8, 0.05 * 255, 0.20 * 255, 1.5, 3, 2, 1),
    "srgb": Sensor(3, 0.05 * 255, 0.15 * 255, 2.0, 5, 1, 2),
}

# Bands shown as red, green and blue.
DISPLAY_BANDS = {"pan": (0, 0, 0), "wv02_ms": (4, 2, 1), "srgb": (0, 1, 2)}

# Bands drawn as red, green and blue in pictures of raw scenes; those of three bands count from 1 there, and from 0 here.
RAW_DISPLAY_BANDS = {"pan": (0, 0, 0), "wv02_ms": (5, 3, 2), "srgb": (0, 1, 2)}

#: Columns of a training set, as runs read it.
TRAINING_ROWS = "label_set string, pos long, label int, features array<double>"


def classes(spark: SparkSession) -> DataFrame:
    """The seven classes as a table: a bounded side for joins."""
    return spark.createDataFrame(CLASSES, "cls int, name string, red double, green double, blue double")
