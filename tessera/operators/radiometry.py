"""Radiometry: stretches, white balance, band histograms, their peaks and thresholds. DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tiling import per_scene


def stretch(v: Column, low: Column, high: Column) -> Column:
    """A value clamped to [low, high] and spread over 1 to 255, by integer arithmetic; 0 (no data) stays 0.

    Where high is not above low there is no range, and the result is null.
    """
    clamped = F.least(F.greatest(v, low), high)
    spread = F.floor((clamped - low) * 254 / F.when(high > low, high - low)) + 1
    return F.when(v == 0, 0).when(v.isNotNull(), spread).cast("int")


def white_balance(v: Column, reference: Column, largest: Column) -> Column:
    """A value times largest / reference, truncated, within 1 to 255; 0 stays 0. A zero reference gives null."""
    scaled = F.floor(F.try_divide(largest.cast("double"), reference) * v)
    return F.when(v == 0, 0).when(scaled.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(255), scaled))).cast("int")


def balance_bands(pixels: DataFrame, references: dict[str, float]) -> DataFrame:
    largest = F.lit(max(references.values()))
    return pixels.withColumns({b: white_balance(F.col(b), F.lit(r), largest) for b, r in references.items()})


def full_range_params(depths: DataFrame) -> DataFrame:
    """Stretch parameters that use the whole range of a bit depth; depths over 12 bits hold 11."""
    bits = F.when(F.col("src_dtype") > 12, 11).otherwise(F.col("src_dtype"))
    top = (F.pow(F.lit(2), bits) - 1).cast("int")
    return depths.select(
        "src_dtype", "bands", F.lit(1).alias("lower"), top.alias("upper"), F.array_repeat(top, F.col("bands")).alias("white"), F.array_repeat(F.lit(1), F.col("bands")).alias("black")
    )


def unpivot_bands(pixels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Wide bands as rows (keys, band: int, dn): a map, no shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col(b).alias("dn")) for i, b in enumerate(bands)]))
    return pixels.select(*keys, each.alias("p")).select(*keys, "p.band", "p.dn")


def band_range(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys).agg(F.min("dn").alias("dn_min"), F.max("dn").alias("dn_max"))


def dn_counts(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dn, n): how often each whole value occurs. Values are counted where they lie, so a shuffle carries at most one row for each value and task."""
    return values.groupBy(*keys, F.floor("dn").alias("dn")).agg(F.count("*").alias("n"))


def histogram_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, dn, h): unit bins from the least value to the one before the largest, empty bins too; the largest value has no bin. Values are not looked at again for the ends."""
    ends = counts.groupBy(*keys).agg(F.min("dn").alias("first"), F.max("dn").alias("last"))
    bins = ends.where("last > first").select(*keys, F.posexplode(F.sequence(F.col("first"), F.col("last") - 1)).alias("i", "dn"))
    return bins.join(counts, [*keys, "dn"], "left").select(*keys, F.col("i").cast("long").alias("i"), "dn", F.coalesce("n", F.lit(0)).alias("h"))


def band_histogram(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, dn, h): counts of unit bins of values, as ``histogram_of`` makes them."""
    return histogram_of(dn_counts(values, keys), keys)


def peak_candidates(histogram: DataFrame, keys: list[str], least_share: float = 0.004) -> DataFrame:
    """Bins of a histogram that may be peaks: (keys, i, dn, h).

    A bin not below its neighbours, nor the bins five away (or the histogram's ends, if nearer), with more than ``least_share`` of
    all. The first bin is compared with the second and sixth, and the last with those before it; for the
    first bin it is the last one's count that has to exceed the share. Histograms of fewer than six bins have
    none of these ends.
    """
    by = Window.partitionBy(*keys).orderBy("i")
    whole = Window.partitionBy(*keys)
    h = F.col("h")
    look = {
        "before": F.lag("h").over(by), "behind": F.lead("h").over(by), "before5": F.lag("h", 5).over(by), "behind5": F.lead("h", 5).over(by),
        "first_h": F.first("h").over(by.rowsBetween(Window.unboundedPreceding, 0)), "last_h": F.last("h").over(by.rowsBetween(0, Window.unboundedFollowing)),
        "bins": F.count("*").over(whole), "total": F.sum("h").over(whole),
    }
    least = F.floor(F.col("total") * least_share)
    last = F.col("i") == F.col("bins") - 1
    inner = (h >= F.col("before")) & (h >= F.col("behind")) & (h >= F.coalesce("before5", "first_h")) & (h >= F.coalesce("behind5", "last_h")) & (h > least)
    first_ok = (h >= F.col("behind")) & (h >= F.col("behind5")) & (F.col("last_h") > least)
    last_ok = (h >= F.col("before")) & (h >= F.col("before5")) & (h > least)
    chosen = F.when(F.col("i") == 0, first_ok).when(last, last_ok).otherwise(inner)
    return histogram.withColumns(look).where(chosen).select(*keys, "i", "dn", "h")


def _thinned(peaks: Column, reach: Column) -> Column:
    """Peaks (an array of dn and h, dn ascending) that are left when near ones give way once.

    Neighbours nearer than ``reach`` are compared in order, and the lower goes, the right one of equals; a peak right of one that stays is not compared
    with it again. A fold whose state is what stays, and the peak to compare the next one with, if any.
    """
    peak = "struct<dn:bigint,h:bigint>"
    state = lambda stay, left: F.struct(stay.alias("stay"), left.alias("left"))
    none = F.lit(None).cast(peak)

    def step(s: Column, right: Column) -> Column:
        left, settled = s["left"], F.concat(s["stay"], F.array(s["left"]))
        near = right["dn"] - left["dn"] < reach
        return F.when(left.isNull() | (near & (left["h"] < right["h"])), state(s["stay"], right)).when(near, state(settled, none)).otherwise(state(settled, right))

    start = state(F.array().cast(f"array<{peak}>"), none)
    return F.aggregate(peaks, start, step, lambda s: F.when(s["left"].isNull(), s["stay"]).otherwise(F.concat(s["stay"], F.array(s["left"]))))


def thin_peaks(peaks: Column) -> Column:
    """Peaks (an array of dn and h, dn ascending) thinned with a reach of 5, 10, ... up to a sixth of their span, 5 at least."""
    span = F.element_at(peaks, -1)["dn"] - F.element_at(peaks, 1)["dn"]
    most = F.greatest(F.lit(5), F.floor(span / 6).cast("int"))
    return F.when(F.size(peaks) > 1, F.aggregate(F.sequence(F.lit(5), most, F.lit(5)), peaks, _thinned)).otherwise(peaks)


def peaks(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, peak: long): candidates thinned for each image and band. A group has at most as many rows as its histogram has bins."""
    one = F.struct(F.col("dn").cast("long").alias("dn"), F.col("h").cast("long").alias("h"))
    gathered = candidates.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_peaks"))
    return gathered.select(*keys, F.explode(thin_peaks(F.col("_peaks"))).alias("_peak")).select(*keys, F.col("_peak.dn").alias("peak"))


def thresholds(histogram: DataFrame, peak_ends: DataFrame, keys: list[str], src_dtype: int = 8, top: float = 0.15, bottom: float = 0.5) -> DataFrame:
    """(keys, lower, upper, white, black): where to cut a band, from its first and last peak (``peak_ends``: keys, low, high; values).

    upper: from the last peak in steps of two bins to the first with at most ``top`` of its count, or the last bin. lower: from
    the first peak down to the first bin with at most ``bottom`` of its count, or the first bin; then, where the low peak is wide or the peaks
    lie close, at most 8 % of the sensor's range. white and black keep the cuts as found. A band without peaks is cut at its last and its first bin.
    """
    full = 2047 if src_dtype > 8 else 255
    on = [F.col(f"e.{k}") == F.col(f"g.{k}") for k in keys] or [F.lit(True)]
    joined = histogram.alias("g").join(peak_ends.alias("e"), on, "left")
    rows = joined.select(*[F.col(f"g.{k}") for k in keys], F.col("g.i"), F.col("g.dn"), F.col("g.h"), F.col("e.low"), F.col("e.high"))
    at = lambda value: F.max(F.when(F.col("dn") == F.col(value), F.col("h"))).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    rows = rows.withColumns({"h_low": at("low"), "h_high": at("high")})
    up = (F.col("dn") >= F.col("high")) & ((F.col("dn") - F.col("high")) % 2 == 0) & (F.col("h") <= top * F.col("h_high"))
    down = (F.col("dn") <= F.col("low")) & (F.col("h") <= bottom * F.col("h_low"))
    found = rows.groupBy(*keys).agg(
        F.least(F.coalesce(F.min(F.when(up, F.col("dn"))), F.max("dn")), F.max("dn")).alias("white"), F.coalesce(F.max(F.when(down, F.col("dn"))), F.min("dn")).alias("black"),
        F.first("low").alias("low"), F.first("high").alias("high"),
    )
    wide = ((F.col("low") - F.col("black")) / F.lit(float(full)) >= 0.03) | ((F.col("high") - F.col("low")) < full / 3)
    lower = F.when(wide, F.least("black", F.lit(int(full * 0.08)))).otherwise(F.col("black"))
    return found.select(*keys, lower.alias("lower"), F.col("white").alias("upper"), "white", "black")


def image_params(band_params: DataFrame, keys: list[str], src_dtype: int = 8) -> DataFrame:
    """(keys, lower, upper) of an image, from (keys, lower, upper, peaks) of its bands.

    The widest of the bands' cuts; with no more than one peak a band, upper is at least a share of the sensor's range. An image without any cuts, or whose cuts leave
    no range (one value all over, or two), keeps the sensor's whole range.
    """
    full, share = (2047, 0.25) if src_dtype > 8 else (255, 0.8)
    whole = band_params.groupBy(*keys).agg(F.min("lower").alias("low"), F.max("upper").alias("high"), F.sum("peaks").alias("peaks"), F.count("*").alias("bands"))
    upper = F.when(F.col("peaks") <= F.col("bands"), F.greatest("high", F.lit(int(full * share)))).otherwise(F.col("high"))
    usable = F.coalesce(F.least("low", F.lit(2048)) < upper, F.lit(False))
    return whole.select(*keys, F.when(usable, F.col("low")).otherwise(1).cast("long").alias("lower"), F.when(usable, upper).otherwise(full).cast("long").alias("upper"))


def stretch_from_histogram(values: DataFrame, keys: list[str], src_dtype: int = 8) -> DataFrame:
    """(keys, lower, upper, white, black) of images, from their values (keys, band, dn): the whole way from histograms to cuts, in one pass over the values.

    Every band's histogram, its peaks, thinned, and the cuts that they give; then the images' widest cuts, and the bands' references as arrays
    in order of the bands. A band without peaks has no cuts of its own: its white is the image's largest, so that balancing leaves it as it is, and its black the
    image's lower cut.
    """
    of = [*keys, "band"]
    counts = dn_counts(values, of)
    histogram = histogram_of(counts, of)
    ends = peaks(peak_candidates(histogram, of), of).groupBy(*of).agg(F.min("peak").alias("low"), F.max("peak").alias("high"), F.count("*").alias("peaks"))
    cuts = thresholds(histogram, ends, of, src_dtype).join(ends.select(*of, "peaks"), of)
    bands = counts.select(*of).distinct().join(cuts, of, "left").withColumn("peaks", F.coalesce("peaks", F.lit(0)))
    references = bands.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("band", "white", "black"))).alias("each"), F.max("white").alias("largest"))  # a handful of bands
    or_else = lambda c, other: F.transform("each", lambda s: F.coalesce(s[c], other).cast("double")).alias(c)
    found = image_params(bands, keys, src_dtype).join(references, keys)
    return found.select(*keys, "lower", "upper", or_else("white", F.coalesce("largest", "upper")), or_else("black", F.col("lower")))


def corrected(pixels: DataFrame, params: DataFrame, keys: list[str], bands: list[str], balance: bool) -> DataFrame:
    """``pixels`` stretched to 8 bits, and balanced if asked, by the parameters of their image (a row an image)."""
    references = {f"_white{i}": F.get("white", F.lit(i)) for i in range(len(bands))} | {"_largest": F.array_max("white")}
    joined = per_scene(pixels, params.select(*keys, "lower", "upper", *(v.alias(k) for k, v in references.items())), keys)
    out = joined.withColumns({b: stretch(F.col(b), F.col("lower"), F.col("upper")) for b in bands})
    if balance:  # a step of its own: in one expression, stretched values would be written out wherever they are named, in code that is too long to be compiled
        out = out.withColumns({b: white_balance(F.col(b), F.col(f"_white{i}"), F.col("_largest")) for i, b in enumerate(bands)})
    return out.select(*pixels.columns)


def display_histogram(values: DataFrame, bins: int = 1000) -> DataFrame:
    """(bin, n): counts of ``dn`` in equal bins between its ends; the largest value falls in the last."""
    ends = values.agg(F.min("dn").alias("low"), F.max("dn").alias("high"))
    at = F.least(F.floor((F.col("dn") - F.col("low")) * bins / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))), F.lit(bins - 1))
    return values.join(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
