"""Names, dates and seasons of scenes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day of the year of scenes without a date: 1 June of a common year.
DEFAULT_DAY = 152
IMAGE_TYPES = (".tif", ".tiff", ".jpg")


def extension(name: Column) -> Column:
    """Lower-case extension with its point; empty without one."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def hidden(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def is_image(name: Column) -> Column:
    return ~hidden(name) & extension(name).isin(*IMAGE_TYPES)


def matches(name: Column, keyword: str, strict: bool) -> Column:
    """Whether a keyword occurs in the extension (strict) or anywhere in the lower-case name; hidden files never match."""
    return ~hidden(name) & F.contains(extension(name) if strict else F.lower(name), F.lit(keyword))


def day_of_year(exif: Column, nitf: Column, sensor: str) -> Column:
    """Day of the year of a scene: from the month and day of EXIF dates (taken as of 2014), or the date of NITF ones.

    No date, or none that exists, gives the default day.
    """
    text = F.concat(F.lit("2014-"), F.substring(exif, 6, 2), F.lit("-"), F.substring(exif, 9, 2)) if sensor == "srgb" else F.concat_ws("-", F.substring(nitf, 1, 4), F.substring(nitf, 5, 2), F.substring(nitf, 7, 2))
    return F.coalesce(F.dayofyear(text.try_cast("date")), F.lit(DEFAULT_DAY))


def season(day: Column) -> Column:
    return F.when(day <= 150, "spring").otherwise("summer")


def training_names(label_set: Column, sensor: Column) -> dict[str, Column]:
    """Names of a label set's labels and features in a stored training set: sets of sRGB scenes other than the sensor's own have features of their own."""
    own = (sensor == "srgb") & (label_set != "srgb")
    name = lambda end, other: F.when(own, F.concat(label_set, F.lit(end))).otherwise(other)
    return {"labels": name("_labels", label_set), "features": name("_feature_matrix", F.lit("feature_matrix"))}


def output_names(name: Column) -> dict[str, Column]:
    """Names of what a run writes for a scene, and of its pansharpened form."""
    base = base_name(name)
    return {k: F.concat(base, F.lit(end)) for k, end in (("raster", "_classified.tif"), ("report", "_md.csv"), ("pansharpened", "_u08rf3413_pansh.tif"))}
