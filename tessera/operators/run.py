"""A batch run: from scenes' pixels to class rasters and reports."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import DEFAULT_DAY, season
from tessera.model import SENSORS
from tessera.operators import classify, kernels, radiometry, scene, segments, tiling, training
from tessera.sources.staging import discard, staged


@dataclass(frozen=True)
class Options:
    """What a run is told: ``stretch`` is ``hist`` (from histograms), or ``none`` or ``pansh`` (the whole range of ``src_dtype`` bits); ``training_label``
    names the label set of scenes whose season does not; blocks are ``block`` pixels each way. Blocks are independent of each other, unless there is a ``halo``: then
    segments are the scene's, and go on across blocks."""

    sensor: str = "srgb"
    stretch: str = "hist"
    src_dtype: int = 8
    training_label: str | None = None
    block: int = 512
    halo: int = 0
    trees: int = 100
    depth: int = 12
    seed: int = 17

    def bands(self) -> list[str]:
        return [f"b{k}" for k in range(SENSORS[self.sensor].bands)]


class Run(NamedTuple):
    """painted: (image_id, x, y, block, seg, cls), class 0 without data. report: image_id, quality score and the classes' pixels."""

    painted: DataFrame
    report: DataFrame


def stretch_params(pixels: DataFrame, options: Options) -> DataFrame:
    """(image_id, lower, upper, white, black): a row for each image."""
    if options.stretch == "hist":
        return radiometry.stretch_from_histogram(radiometry.unpivot_bands(pixels, ["image_id"], options.bands()), ["image_id"], options.src_dtype)
    if options.stretch not in ("none", "pansh"):
        raise ValueError("stretch is hist, none or pansh")
    depth = pixels.sparkSession.createDataFrame([(options.src_dtype, len(options.bands()))], "src_dtype int, bands int")
    whole = radiometry.full_range_params(depth).select("lower", "upper", F.col("white").cast("array<double>").alias("white"), F.col("black").cast("array<double>").alias("black"))
    return pixels.select("image_id").distinct().join(F.broadcast(whole))  # one row


def blocked(pixels: DataFrame, size: int) -> DataFrame:
    """``pixels`` with block (its image, row and column), r and c (their place in it), and h and w (its size, clipped at the scene's ends)."""
    extent = staged(tiling.extents(pixels, ["image_id"]).drop("n"), "extents")
    placed = tiling.per_scene(tiling.assign_blocks(pixels, size, size), extent, ["image_id"])
    left = lambda n, at: F.least(F.lit(size), F.col(n) - F.col(at) * size)
    return placed.withColumns({"block": F.concat_ws("/", "image_id", "block_row", "block_col"), "h": left("rows", "block_row"), "w": left("cols", "block_col")}).drop(
        "block_row", "block_col", "rows", "cols"
    )


def segment_features(segmented: DataFrame, images: DataFrame, params: DataFrame, sensor: str, whole: bool = False) -> DataFrame:
    """(image_id, block, seg, features: array<double>): every segment, also those without data, whose features are 0, as are undefined ones.

    What lies around segments is counted by a kernel in each block, or, where a block is a ``whole`` scene (and in other sensors' features), by a join.
    """
    place = segmented.select("block", "seg", F.col("r").alias("x"), F.col("c").alias("y"), "h", "w", *(c for c in segmented.columns if c.startswith("b") and c[1:].isdigit()))
    options = {"wv02_ms": {"white": [1.0] * 8, "black": [1.0] * 8}, "pan": {"day_of_year": DEFAULT_DAY}}.get(sensor, {})
    if sensor == "srgb" and not whole:
        options["around"] = kernels.neighbour_counts(place, height="h")
    rows = segments.features(sensor, place, F.col("h"), F.col("w"), **options)
    rows = segmented.select("image_id", "block", "seg").distinct().join(rows, ["block", "seg"], "left")
    if sensor == "wv02_ms":  # by the references of each image
        rows = rows.join(params.select("image_id", "white", "black"), "image_id")
        by = lambda b, ref: F.try_divide(F.col(f"f{b}"), F.get(ref, F.lit(b)))
        rows = rows.withColumns({f"f{16 + b}": by(b, "white") for b in range(7)} | {f"f{23 + b}": by(b, "black") for b in range(8)})
    elif sensor == "pan":
        rows = rows.join(images.select("image_id", "day"), "image_id", "left").withColumn("f11", F.coalesce("day", F.lit(DEFAULT_DAY)).cast("double"))
    count = {"srgb": 16, "wv02_ms": 31, "pan": 12}[sensor]
    return rows.select("image_id", "block", "seg", F.array(*(F.coalesce(F.col(f"f{i}").cast("double"), F.lit(0.0)) for i in range(count))).alias("features"))


def label_sets(scenes: DataFrame, images: DataFrame, options: Options) -> DataFrame:
    """(image_id, label_set) of ``scenes`` (image_id): by the season in sRGB; one without a day, or that ``images`` does not list, has the default day."""
    named = season(F.coalesce("day", F.lit(DEFAULT_DAY))) if options.sensor == "srgb" else F.lit(options.training_label or options.sensor)
    return scenes.select("image_id").join(images.select("image_id", "day"), "image_id", "left").select("image_id", named.alias("label_set"))


def predictions(features: DataFrame, sets: DataFrame, rows: DataFrame, options: Options) -> DataFrame:
    """(block, seg, cls), staged: classes by a forest for each label set of ``sets`` (image_id, label_set), each fitted once. A set without usable training rows is an error that names it."""
    rows, forests = staged(rows, "training"), {}
    for (label_set,) in sorted(sets.select("label_set").distinct().collect()):  # two seasons at most
        mine = training.training_rows(rows, label_set, options.sensor)
        if mine.isEmpty():
            raise ValueError(f"no usable training rows for the label set {label_set}, nor for {options.sensor}")
        forests[label_set] = classify.fit_forest(mine, "features", trees=options.trees, depth=options.depth, seed=options.seed)
    asked = staged(tiling.per_scene(features, sets, ["image_id"]), "features")
    out = [classify.predict(forest, asked.where(F.col("label_set") == label_set), "features").select("block", "seg", "cls") for label_set, forest in forests.items()]
    found = staged(out[0] if len(out) == 1 else out[0].unionByName(out[1]), "predictions")
    discard(rows)
    discard(asked)
    return found


def block_segments(fixed: DataFrame, options: Options) -> DataFrame:
    """Corrected pixels with seg, from 0 in each block."""
    keep = ("image_id", "r", "c", "h", "w", *options.bands())
    return segments.rebase_labels(kernels.segment_blocks(fixed, options.bands(), options.sensor, keep=keep))


def scene_segments(fixed: DataFrame, options: Options) -> DataFrame:
    """Corrected pixels with seg, the scene's own; a scene is one block."""
    found = scene.segments_scene(fixed.select("image_id", "x", "y", *options.bands()), ["image_id"], options.bands(), options.sensor, size=options.block, halo=options.halo)
    extent = staged(tiling.extents(fixed, ["image_id"]).select("image_id", F.col("rows").alias("h"), F.col("cols").alias("w")), "extents")
    whole = tiling.per_scene(found, extent, ["image_id"])
    return whole.withColumns({"block": F.col("image_id"), "r": F.col("x"), "c": F.col("y")})


def classify_scenes(pixels: DataFrame, images: DataFrame, rows: DataFrame, options: Options = Options(), segmented: DataFrame | None = None) -> Run:
    """Classes of all scenes' pixels, and a report for each.

    ``pixels``: (image_id, x, y, b0, ...) with raw values, 0 without data; ``images``: (image_id, day: of the year, or null); ``rows``: training rows (label_set,
    pos, label, features). Scenes are scored (sRGB), stretched, balanced (sRGB), cut to blocks and segmented there; segments are
    described, classified and painted. ``segmented``, if given, stands for the result of segmentation: corrected pixels with block, seg, r, c, h and w.
    Segmented pixels are staged, as kernels are dear and their result is read several times.
    """
    bands, own = options.bands(), ("image_id",)
    raw = blocked(pixels, options.block)
    params = staged(stretch_params(pixels, options), "stretch")
    if segmented is None:
        fixed = radiometry.corrected(raw, params, ["image_id"], bands, balance=options.sensor == "srgb")
        segmented = staged(scene_segments(fixed, options) if options.halo else block_segments(fixed, options), "segments")
    features = segment_features(segmented, images, params, options.sensor, whole=options.halo > 0)
    found = predictions(features, staged(label_sets(params, images, options), "label-sets"), rows, options)
    painted = classify.paint(segmented, found, bands[:3], keep=own)
    if options.sensor == "srgb":
        quality = classify.quality_min(kernels.block_quality(raw, keep=own))
    else:
        quality = params.select("image_id", F.lit(1.0).alias("quality"))
    return Run(painted, classify.report(classify.class_counts(painted, ["image_id"]), quality, ["image_id"]))
