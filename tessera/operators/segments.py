"""Segments: statistics of their pixels and of the pixels around them, and feature rows. Keys start with the block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFFSETS = (-4, -3, 3, 4)
KEY = ("block", "seg")


def moments(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """(block, seg, n, mean_<b>, std_<b>): over pixels with data (b0 not 0). One partial and one final aggregate."""
    of = [f(b).alias(f"{name}_{b}") for b in bands for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return pixels.where("b0 <> 0").groupBy(*KEY).agg(F.count("*").alias("n"), *of)


def value_counts(pixels: DataFrame, value: str) -> DataFrame:
    return pixels.groupBy(*KEY, F.col(value).alias("v")).agg(F.count("*").alias("c"))


def entropy(counts: DataFrame) -> DataFrame:
    """(block, seg, entropy): base 2, of the shares of counts ``c``; from their logs' sum, so one aggregate is enough."""
    total, logs = F.sum("c"), F.sum(F.col("c") * F.log2("c"))
    return counts.groupBy(*KEY).agg((F.log2(total) - logs / total).alias("entropy"))


def neighbours(pixels: DataFrame, height: int | Column, width: int | Column, mode: str = "literal", values: tuple[str, ...] = ("b0", "b1", "b2")) -> DataFrame:
    """The pixels around segments: (block, seg, <values>), a row for each time one is met.

    From every pixel with data, those 3 and 4 rows and columns away in the same block that belong to another segment. ``mode``:
    ``clean`` probes rows and columns on their own; ``literal`` probes columns at an offset only where the row at that offset lies in the
    block; ``training`` is literal, but what is met must differ from segment 0, not from the pixel's own.
    Probes are generated, and joined by place: an equi-join with the segment as a residual, keyed by block first. ``height`` and
    ``width`` are a block's, one for all or columns of ``pixels``.
    """
    local = F.col("x") % height
    probe = lambda dx, dy, ok: F.when(ok, F.struct((F.col("x") + dx).alias("px"), (F.col("y") + dy).alias("py")))
    probes = []
    for o in OFFSETS:
        row_ok = (local + o).between(0, height - 1)
        col_ok = (F.col("y") + o).between(0, width - 1)
        probes += [probe(o, 0, row_ok), probe(0, o, col_ok if mode == "clean" else col_ok & row_ok)]
    met = pixels.where("b0 <> 0").select(*KEY, F.explode(F.filter(F.array(*probes), lambda p: p.isNotNull())).alias("p")).select(*KEY, "p.px", "p.py")
    others = pixels.select(F.col("block").alias("ob"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("seg").alias("oseg"), *values)
    differs = F.col("oseg") != (F.lit(0) if mode == "training" else F.col("seg"))
    return met.join(others, (F.col("block") == F.col("ob")) & (met["px"] == others["px"]) & (met["py"] == others["py"]) & differs).select(*KEY, *values)


def neighbours_by_window(pixels: DataFrame, value: str = "b1") -> DataFrame:
    """``neighbours`` in clean mode, for dense blocks without gaps: shifted reads along rows and columns, no join."""
    down, across = Window.partitionBy("block", "y").orderBy("x"), Window.partitionBy("block", "x").orderBy("y")
    at = lambda w, o: F.lead(F.struct("seg", value), o).over(w) if o > 0 else F.lag(F.struct("seg", value), -o).over(w)
    shifted = pixels.withColumn("around", F.array(*[at(w, o) for w in (down, across) for o in OFFSETS])).where("b0 <> 0")
    met = shifted.select(*KEY, F.explode("around").alias("p")).where(F.col("p.seg") != F.col("seg"))
    return met.select(*KEY, F.col(f"p.{value}").alias(value))


def around_stats(met: DataFrame, values: tuple[str, ...] = ("b1",)) -> DataFrame:
    """(block, seg, ext_n, ext_mean_<v>, ext_std_<v>, ext_max_<v>) of the pixels around segments."""
    of = [f(v).alias(f"ext_{name}_{v}") for v in values for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.max, "max"))]
    return met.groupBy(*KEY).agg(F.count("*").alias("ext_n"), *of)


def counted_stats(counts: DataFrame) -> DataFrame:
    """(block, seg, ext_n, ext_mean, ext_std, ext_max, ext_entropy) of value counts (block, seg, v, c), in one aggregate.

    Sums of whole numbers are exact, so equal values have no deviation.
    """
    v, c = F.col("v").cast("long"), F.col("c")
    wide = lambda name: F.col(name).cast("decimal(38,0)")
    sums = counts.groupBy(*KEY).agg(
        F.sum(c).alias("ext_n"), F.sum(v * c).alias("s1"), F.sum(v * v * c).alias("s2"), F.max("v").alias("ext_max"), F.sum(c * F.log2(c)).alias("logs")
    )
    spread = F.sqrt((wide("ext_n") * wide("s2") - wide("s1") * wide("s1")).cast("double")) / F.col("ext_n")
    return sums.select(
        *KEY, "ext_n", (F.col("s1") / F.col("ext_n")).alias("ext_mean"), spread.alias("ext_std"), "ext_max",
        (F.log2(F.col("ext_n").cast("double")) - F.col("logs") / F.col("ext_n")).alias("ext_entropy"),
    )


def _mean(band: int | str) -> Column:
    return F.greatest(F.lit(1.0), F.col(f"mean_b{band}"))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def features_srgb(pixels: DataFrame, height: int | Column, width: int | Column, mode: str = "literal", around: DataFrame | None = None) -> DataFrame:
    """16 features (f0 to f15) of segments of 3-band scenes: means, deviations, band ratios, size, entropy, and what lies around.

    What lies around is counted by value once; ``around`` gives these counts (block, seg, v, c) where a kernel has made them.
    """
    stats = moments(pixels, ["b0", "b1", "b2"])
    inside = entropy(value_counts(pixels.where("b0 <> 0"), "b1"))
    outside = counted_stats(value_counts(neighbours(pixels, height, width, mode, ("b1",)), "b1") if around is None else around)
    rows = stats.join(inside, list(KEY)).join(outside, list(KEY), "left")
    m0, m1, m2 = (_mean(b) for b in range(3))
    spread = 2 * m2 - m1 - m0
    values = [
        m0, m1, m2, F.col("std_b0"), F.col("std_b1"), F.col("std_b2"), _ratio(m2 - m0, m2 + m0), _ratio(m2 - m1, m2 + m1),
        F.when(spread < 1, F.lit(0.0)).otherwise(_ratio(m1 - m0, spread)), F.col("n").cast("double"), F.col("entropy"),
        *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("ext_mean", "ext_std", "ext_max", "ext_entropy")), F.lit(0.0),
    ]
    return rows.select(*KEY, *(v.alias(f"f{i}") for i, v in enumerate(values)))


def features_ms(pixels: DataFrame, height: int | Column, width: int | Column, white: list[float], black: list[float], mode: str = "literal") -> DataFrame:
    """31 features of segments of 8-band scenes; ``white`` and ``black``: the bands' reference values (0 gives null)."""
    stats = moments(pixels, [f"b{k}" for k in range(8)])
    around = around_stats(neighbours(pixels, height, width, mode, ("b3", "b4", "b7")), ("b3", "b7"))
    rows = stats.join(around, list(KEY), "left")
    m = [_mean(b) for b in range(8)]
    values = [
        *m, F.col("std_b6"), _ratio(m[0], m[2]), _ratio(m[1], m[6]), _ratio(m[3], m[6]),
        F.coalesce("ext_mean_b3", F.lit(0.0)), F.coalesce("ext_mean_b7", F.lit(0.0)), _ratio(m[0] - m[6], m[0] + m[6]), _ratio(m[2] - m[4], m[2] + m[4]),
        *(_ratio(m[b], F.lit(float(white[b]))) for b in range(7)), *(_ratio(m[b], F.lit(float(black[b]))) for b in range(8)),
    ]
    return rows.select(*KEY, *(v.alias(f"f{i}") for i, v in enumerate(values)))


def features_pan(pixels: DataFrame, height: int | Column, width: int | Column, day_of_year: int, mode: str = "clean") -> DataFrame:
    """12 features of segments of 1-band scenes: mean, median, ends, deviation, size, entropy, what lies around, and the day of the year."""
    own = pixels.where("b0 <> 0").groupBy(*KEY).agg(
        F.greatest(F.avg("b0"), F.lit(1.0)).alias("mean"), F.median("b0").alias("median"), F.min("b0").alias("low"), F.max("b0").alias("high"),
        F.stddev_pop("b0").alias("std"), F.count("*").alias("n"),
    )
    inside = entropy(value_counts(pixels.where("b0 <> 0"), "b0"))
    outside = counted_stats(value_counts(neighbours(pixels, height, width, mode, ("b0",)), "b0"))
    rows = own.join(inside, list(KEY)).join(outside, list(KEY), "left")
    values = [
        *(F.col(c).cast("double") for c in ("mean", "median", "low", "high", "std", "n", "entropy")),
        *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("ext_mean", "ext_std", "ext_max", "ext_entropy")), F.lit(float(day_of_year)),
    ]
    return rows.select(*KEY, *(v.alias(f"f{i}") for i, v in enumerate(values)))


def features(sensor: str, pixels: DataFrame, height: int | Column, width: int | Column, **options) -> DataFrame:
    """Feature rows of a sensor's scenes."""
    return {"srgb": features_srgb, "wv02_ms": features_ms, "pan": features_pan}[sensor](pixels, height, width, **options)


def runs(pixels: DataFrame, bands: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, block, seg, empty, x, first, last): a raster as runs of neighbouring pixels of a row (y from first to last) that are of one segment, and all empty (0 or null in all ``bands``) or none.

    Where y runs on, y less the pixel's number among those alike in its row stays the same. Columns to keep are the same all over a block.
    """
    none = F.lit(True)
    for b in bands:
        none = none & (F.coalesce(b, F.lit(0)) == 0)
    alike = [*keep, "block", "seg", "empty", "x"]
    placed = pixels.select(*keep, "block", "seg", none.alias("empty"), "x", "y")
    number = F.row_number().over(Window.partitionBy(*alike).orderBy("y"))
    return placed.withColumn("_run", F.col("y") - number).groupBy(*alike, "_run").agg(F.min("y").alias("first"), F.max("y").alias("last")).drop("_run")


def rebase_labels(pixels: DataFrame) -> DataFrame:
    """Pixels with ``seg`` from 0 in each block."""
    least = F.min("seg").over(Window.partitionBy("block"))
    return pixels.withColumn("seg", F.when(least > 0, F.col("seg") - least).otherwise(F.col("seg")))


def dense_ids(pixels: DataFrame) -> DataFrame:
    """(block, seg, n): every id from 0 to the block's largest, with the count of its pixels with data, empty ids too."""
    ids = pixels.groupBy("block").agg(F.max("seg").alias("last")).select("block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("seg"))
    counts = pixels.where("b0 <> 0").groupBy(*KEY).agg(F.count("*").alias("n"))
    return ids.join(counts, list(KEY), "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("n"))


def bounding_boxes(pixels: DataFrame, margin: int, rows: int, cols: int) -> DataFrame:
    """(block, seg, x_min, x_max, y_min, y_max): a segment's extent and a margin, within the scene."""
    return pixels.groupBy(*KEY).agg(
        F.greatest(F.min("x") - margin, F.lit(0)).alias("x_min"), F.least(F.max("x") + margin, F.lit(rows - 1)).alias("x_max"),
        F.greatest(F.min("y") - margin, F.lit(0)).alias("y_min"), F.least(F.max("y") + margin, F.lit(cols - 1)).alias("y_max"),
    )


def empty_groups(pixels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """(keys, no_segments, no_classes): whether a group's first band stays at 1 or below, and all bands below 2."""
    return pixels.groupBy(*keys).agg((F.max("b0") <= 1).alias("no_segments"), (F.max(F.greatest(*bands)) < 2).alias("no_classes"))


def boundary_pixels(pixels: DataFrame) -> DataFrame:
    """(block, x, y): pixels with a pixel of another segment next to them in a row or column of the block."""
    down, across = Window.partitionBy("block", "y").orderBy("x"), Window.partitionBy("block", "x").orderBy("y")
    other = [f("seg").over(w) != F.col("seg") for w in (down, across) for f in (F.lag, F.lead)]
    edge = F.coalesce(other[0], F.lit(False))
    for o in other[1:]:
        edge = edge | F.coalesce(o, F.lit(False))
    return pixels.withColumn("edge", edge).where("edge").select("block", "x", "y")


def segment_at(pixels: DataFrame, points: DataFrame) -> DataFrame:
    """(x, y, block, seg): the segments at ``points`` (x, y); a place outside the scene has none."""
    return points.select("x", "y").distinct().join(pixels.select("x", "y", "block", "seg"), ["x", "y"])
