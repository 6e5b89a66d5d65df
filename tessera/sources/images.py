"""Image files as tasks, and what is pending; pixel tables, class rasters and training sets in Parquet. Image formats are not decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.names import is_image, matches, output_names
from tessera.model import TRAINING_ROWS


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(name, dir, path, length) of a folder's files, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), "path", "length")


def image_tasks(files: DataFrame, destination: str | None = None) -> DataFrame:
    """A task for each image among files (name, dir): (image_id, src_dir, dst_dir, complete)."""
    to = F.lit(destination) if destination else F.concat(F.col("dir"), F.lit("/classified"))
    return files.where(is_image(F.col("name"))).select(F.col("name").alias("image_id"), F.col("dir").alias("src_dir"), to.alias("dst_dir"), F.lit(False).alias("complete"))


def scan_union(files: DataFrame, keywords: list[str], strict: bool = True) -> DataFrame:
    """Names that match any of the keywords, once each."""
    found = [files.where(matches(F.col("name"), k, strict)).select("name") for k in keywords]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0].distinct()


def pending(tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    """Tasks whose classified raster is not among ``outputs`` (name), nor marked complete."""
    named = tasks.where(~F.col("complete")).withColumn("_raster", output_names(F.col("image_id"))["raster"])
    return named.join(outputs.select(F.col("name").alias("_raster")), "_raster", "left_anti").drop("_raster")


def training_file(sensor: str) -> str:
    """The name that a sensor's training set has by default."""
    return f"{sensor}_training_data"


def checked_training_set(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of a training set, in its types; what is missing is an error that names it."""
    wanted = {name: kind for name, kind in (c.split(" ") for c in TRAINING_ROWS.split(", "))}
    if missing := [c for c in wanted if c not in rows.columns]:
        raise ValueError(f"not a training set: no {', '.join(missing)}")
    return rows.select(*(F.col(c).cast(kind).alias(c) for c, kind in wanted.items()))


def open_training_set(spark: SparkSession, path: str) -> DataFrame:
    """A stored training set, or an empty one where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], TRAINING_ROWS)
    return checked_training_set(spark.read.parquet(path))


def classified(spark: SparkSession, path: str, images: list[str] | None = None) -> DataFrame:
    """Class rasters as ``sinks.write_classified`` leaves them; of some images only, if named, whose folders alone are read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("image_id").isin(images)) if images is not None else rows
