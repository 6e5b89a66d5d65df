"""Classes of segments: forests fitted once, classes painted on pixels, and counts of them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import REPORT_COLUMNS
from tessera.operators.ordered import running


def fit_forest(rows: DataFrame, features: list[str] | str, label: str = "label", *, trees: int = 100, depth: int = 12, seed: int = 17) -> RandomForestClassificationModel:
    """A forest of ``trees``, fitted once for a sensor and label set; ``features``: columns, or one array column."""
    vector = array_to_vector(F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(f).cast("double") for f in features)))
    forest = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=trees, maxDepth=depth, maxBins=256, featureSubsetStrategy="sqrt", seed=seed)
    return forest.fit(rows.select(vector.alias("v"), F.col(label).cast("double").alias("y")))


def predict(model: RandomForestClassificationModel, rows: DataFrame, features: list[str] | str) -> DataFrame:
    """``rows`` with cls, the most likely class, and confidence, its probability."""
    vector = array_to_vector(F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(f).cast("double") for f in features)))
    out = model.transform(rows.withColumn("v", vector))
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("cls"), F.array_max(vector_to_array("probability")).alias("confidence"))


def review_seconds(confidence) -> object:
    """How long a prediction is shown before it is taken: the surer, the shorter; exactly 0.9 counts as sure."""
    return F.when((confidence > 0.9) & (confidence < 0.96), 4.0).when(confidence < 0.9, 10.0).otherwise(0.5)


def paint(pixels: DataFrame, predictions: DataFrame, bands: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, x, y, block, seg, cls): each pixel's segment's class, 0 where all bands are 0 or null, or the segment has no prediction. No pixel is lost."""
    empty = F.lit(True)
    for b in bands:
        empty = empty & (F.coalesce(b, F.lit(0)) == 0)
    joined = pixels.join(predictions.select("block", "seg", "cls"), ["block", "seg"], "left")
    return joined.select(*keep, "x", "y", "block", "seg", F.when(empty, 0).otherwise(F.coalesce("cls", F.lit(0))).alias("cls"))


def paint_runs(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """``rows`` (runs of segments, as ``segments.runs`` makes them) with cls, as ``paint`` gives it to their pixels: the join reads runs, not pixels."""
    joined = rows.join(predictions.select("block", "seg", "cls"), ["block", "seg"], "left")
    return joined.withColumn("cls", F.when(F.col("empty"), 0).otherwise(F.coalesce("cls", F.lit(0))))


def run_pixels(painted: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, x, y, block, seg, cls): the pixels of painted runs."""
    return painted.select(*keep, "x", F.explode(F.sequence("first", "last")).alias("y"), "block", "seg", "cls")


def run_counts(painted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n1 to n5): as ``class_counts`` of the runs' pixels, which are not made."""
    pixels = (F.col("last") - F.col("first") + 1).cast("long")
    return painted.groupBy(*keys).agg(*(F.sum(F.when(F.col("cls") == k, pixels).otherwise(0)).alias(f"n{k}") for k in range(1, 6)))


def class_counts(painted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n1 to n5): pixels of each class; class 0 is not counted. A single aggregate, whatever the number of classes."""
    return painted.groupBy(*keys).agg(*(F.count_if(F.col("cls") == k).alias(f"n{k}") for k in range(1, 6)))


def class_percent(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts added up over ``keys``, and p1 to p5: each one's share of 1 plus their sum."""
    whole = counts.groupBy(*keys).agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(1, 6))) if keys else counts.agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(1, 6)))
    area = sum((F.col(f"n{k}") for k in range(2, 6)), F.col("n1")) + 1
    return whole.withColumns({f"p{k}": F.round(F.col(f"n{k}") / area, 6) for k in range(1, 6)})


def report(percent: DataFrame, quality: DataFrame, keys: list[str]) -> DataFrame:
    """Per-image report: quality score and counts, under the names of the published columns."""
    named = [F.col(f"n{k}").alias(name) for k, name in enumerate(REPORT_COLUMNS, 1)]
    return percent.join(quality, keys).select(*keys, F.col("quality").alias("Quality Score"), *named)


def quality_min(scores: DataFrame) -> DataFrame:
    """(image_id, quality): the least block score of an image, 1 at most."""
    return scores.groupBy("image_id").agg(F.least(F.min("score"), F.lit(1.0)).alias("quality"))


def quality_running(scores: DataFrame, by: str = "image_id") -> DataFrame:
    """The least score over an image and those before it: what a minimum that is never reset reports."""
    per_image = scores.groupBy("image_id").agg(F.least(F.min("score"), F.lit(1.0)).alias("own"))
    return running(per_image, by, F.min, "own", "quality").select("image_id", "quality")


def confusion(rows: DataFrame, predicted: str, true: str) -> DataFrame:
    """(predicted, true, n, share): pairs' counts, and their share of the true class."""
    counts = rows.groupBy(F.col(predicted).alias("predicted"), F.col(true).alias("true")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("true")), 6))


def importances(rows: DataFrame, features: list[str], label: str = "label", *, trees: int = 100, depth: int = 12, seed: int = 17) -> DataFrame:
    """(place, feature, importance, spread): features by importance, the largest first, beside a column of noise.

    What is less important than ``noise`` tells nothing. spread: the deviation of the importance over the trees. The forest, which
    is a bounded model, is read on the driver; the rows are not.
    """
    spark, names = rows.sparkSession, [*features, "noise"]
    model = fit_forest(rows.withColumn("noise", F.rand(seed)), names, label, trees=trees, depth=depth, seed=seed)
    own = np.array([tree.featureImportances.toArray() for tree in model.trees])
    mean = model.featureImportances.toArray()
    order = sorted(range(len(names)), key=lambda i: (-mean[i], i))
    found = [(place, names[i], float(mean[i]), float(own[:, i].std())) for place, i in enumerate(order, 1)]
    return spark.createDataFrame(found, "place int, feature string, importance double, spread double")


def hold_out(rows: DataFrame, key: str, features: list[str] | str, label: str = "label", *, parts: int = 5, **forest) -> DataFrame:
    """(part, n, right, accuracy): rows of part 0 of a hash of ``key`` predicted by a forest of the others. Stands in for out-of-bag scores, which Spark's forests lack."""
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    model = fit_forest(rows.where(part > 0), features, label, **forest)
    judged = predict(model, rows.where(part == 0), features).select((F.col("cls") == F.col(label)).alias("right"))
    counted = judged.agg(F.lit(0).alias("part"), F.count("*").alias("n"), F.count_if("right").alias("right"))
    return counted.withColumn("accuracy", F.try_divide("right", "n"))
