"""Training rows: labels by position, filters, updates, samples, and what is left to label."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.classify import fit_forest
from tessera.operators.ordered import with_next


def zip_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature rows and labels with the same position; what one side has more of is left out.

    Both grow with the input, and an array's size is estimated as that of one element, so neither is ever broadcast: a merge of both by position.
    """
    return features.join(labels.hint("merge"), "pos")


def usable_labels(rows: DataFrame, label_set: str = "label_set", sensor: str = "srgb") -> DataFrame:
    """Rows without the labels 0 and 6, and without 5 unless the set is ``spring`` or the sensor has eight bands."""
    shadow = (F.col(label_set) == "spring") | F.lit(sensor == "wv02_ms")
    return rows.where(~F.col("label").isin(0, 6) & ((F.col("label") != 5) | shadow))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with their keys, or besides them."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def latest(events: DataFrame, keys: list[str], by: str, value: str) -> DataFrame:
    """(keys, value): the last value logged for each key; the log itself only grows."""
    return events.groupBy(*keys).agg(F.max_by(value, by).alias(value))


def sample_segments(pixels: DataFrame, labelled: DataFrame, least_pixels: int = 20, most: int = 10) -> DataFrame:
    """(block, seg, draw): ``most`` segments by area, of ``least_pixels`` pixels or more and not labelled yet.

    Every pixel draws a number from its place, and a segment has its pixels' least, so large ones come first more often; the same
    pixels give the same sample. Only the last step orders, and keeps ``most`` rows a task.
    """
    draw = (F.col("x") * 7919 + F.col("y") * 104729) % 65537
    segments = pixels.groupBy("block", "seg").agg(F.count("*").alias("pixels"), F.min(draw).alias("draw")).where(F.col("pixels") >= least_pixels)
    return segments.join(labelled, ["block", "seg"], "left_anti").select("block", "seg", "draw").orderBy("draw", "block", "seg").limit(most)


def next_unlabelled(rows: DataFrame, by: str = "pos") -> DataFrame:
    return rows.where(F.col("label").isNull()).orderBy(by).limit(1)


def images_by_first_row(rows: DataFrame, image: str, by: str = "pos") -> DataFrame:
    """(image, first_pos, n): distinct images, where they first occur, and how often."""
    return rows.groupBy(image).agg(F.min(by).alias("first_pos"), F.count("*").alias("n"))


def next_image(images: DataFrame, by: str) -> DataFrame:
    """(image, next_image): the one after it in order; the first after the last."""
    return with_next(images, by, "next_image").select("image", "next_image")


def accept(predictions: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions, replaced by a person's label (0 to 5) where there is one."""
    valid = overrides.where(F.col("label").between(0, 5)).select(*keys, F.col("label").alias("override"))
    return predictions.join(valid, keys, "left").withColumn("label", F.coalesce("override", "cls")).drop("override")


def training_rows(rows: DataFrame, label_set: str, sensor: str) -> DataFrame:
    """Usable labelled rows of ``label_set``, or of the sensor's own set if there are none of it.

    The choice is a condition in the plan, not a job of its own.
    """
    own = rows.where(F.col("label_set") == label_set)
    fallback = rows.where((F.col("label_set") == sensor) & ~own.limit(1).exists())
    return usable_labels(own.unionByName(fallback).where(F.col("label").isNotNull()).withColumn("_for", F.lit(label_set)), "_for", sensor).drop("_for")


def ready_sets(rows: DataFrame, least: int = 10) -> DataFrame:
    """(label_set, n): sets with enough labels for a forest."""
    return rows.groupBy("label_set").agg(F.count("label").alias("n")).where(F.col("n") >= least)


def retrained(rows: DataFrame, features: list[str] | str, model: RandomForestClassificationModel | None = None, *, least: int = 10, **forest) -> RandomForestClassificationModel | None:
    """A new forest once there are ``least`` labelled rows; until then the one there is."""
    labelled = rows.where(F.col("label").isNotNull())
    return fit_forest(labelled, features, **forest) if labelled.limit(least).count() >= least else model


def last_match(names: DataFrame, available: DataFrame) -> DataFrame:
    """(image, path): for each name (image) the last of the ``available`` (place, path) that contains it, if any.

    Each path is cut to pieces as long as some name is (their lengths, a few at most, are read first), so names are joined by
    equality rather than compared with every path.
    """
    wanted = names.select("image").where(F.length("image") > 0).distinct()
    lengths = [r[0] for r in wanted.select(F.length("image")).distinct().collect()]
    if not lengths:
        return wanted.select("image", F.lit(None).cast("string").alias("path"))

    def pieces(n: int) -> Column:
        starts = F.when(F.length("path") >= n, F.sequence(F.lit(1), F.length("path") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(F.col("path"), i, F.lit(n)))

    held = available.select("place", "path", F.explode(F.array_distinct(F.flatten(F.array(*map(pieces, lengths))))).alias("image"))
    return wanted.join(held, "image").groupBy("image").agg(F.max_by("path", "place").alias("path"))
