"""Array kernels over scenes of any size, with results that do not depend on how a scene is cut into blocks.

A block is given a halo: the strip of its neighbours' pixels that its own depend on. Local kernels (smoothing, gradients, ridges, maxima) then work
block by block, and only the block's own pixels are kept. What reaches further is not local: distances are separable scans
along columns and rows, and components are numbered in blocks and connected through the pixels that touch across borders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import SENSORS
from tessera.operators import kernels
from tessera.operators.graph import connected
from tessera.operators.tiling import extents, per_scene
from tessera.sources.staging import staged

def with_halo(pixels: DataFrame, keys: list[str], size: int, halo: int, extent: DataFrame | None = None) -> DataFrame:
    """Pixels, with rows and cols of their scene, once for each block (block_row, block_col; ``size`` pixels each way) that they lie in or within ``halo`` of.

    ``extent``, as ``extents`` gives it, spares a pass over pixels where it is known.
    """
    last = lambda n: F.floor((F.col(n) - 1) / size)
    blocks = lambda at, n: F.sequence(F.greatest(F.floor((F.col(at) - halo) / size), F.lit(0)), F.least(F.floor((F.col(at) + halo) / size), last(n))).cast("array<int>")
    known = staged(extents(pixels, keys), "scene-extents") if extent is None else extent
    placed = per_scene(pixels, known.select(*keys, "rows", "cols"), keys)
    return placed.withColumn("block_row", F.explode(blocks("x", "rows"))).withColumn("block_col", F.explode(blocks("y", "cols")))


def over_scene(
    pixels: DataFrame, keys: list[str], bands: list[str], kernel: Callable[..., np.ndarray], name: str, kind: str, *, halo: int = 0, size: int = 512, keep: tuple[str, ...] = (), placed: bool = False,
    extent: DataFrame | None = None,
) -> DataFrame:
    """(keys, x, y, ``keep``, ``name``): a kernel's array for every pixel, from blocks and the ``halo`` around them, which is all that the kernel may look at.

    A block's arrays (0 where there is no pixel, or a null) end where the scene ends, so a kernel's own rule for borders holds there and only there.
    ``placed``: the kernel is also told the place of its arrays' first pixel, and the scene's columns.
    """
    columns = [*keys, "x", "y", *keep]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row, col, rows, cols = (int(group[c].iloc[0]) for c in ("block_row", "block_col", "rows", "cols"))
        top, left = max(0, row * size - halo), max(0, col * size - halo)
        shape = min(rows, (row + 1) * size + halo) - top, min(cols, (col + 1) * size + halo) - left
        if shape[0] * shape[1] > kernels.MOST_PIXELS:
            raise ValueError(f"a block of {shape[0]} x {shape[1]} pixels with its halo is more than the {kernels.MOST_PIXELS} that a kernel takes: tile the scene finer")
        r, c = group["x"].to_numpy() - top, group["y"].to_numpy() - left
        arrays = [np.zeros(shape) for _ in bands]
        for array, band in zip(arrays, bands):
            array[r, c] = group[band].fillna(0).to_numpy()
        own = ((group["x"] // size == row) & (group["y"] // size == col)).to_numpy()
        out = kernel(arrays, top, left, cols) if placed else kernel(arrays)
        return group.loc[own, columns].assign(**{name: out[r[own], c[own]]})

    schema = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in columns) + f", {name} {kind}"
    cut = with_halo(pixels.select(*dict.fromkeys([*columns, *bands])), keys, size, halo, extent)
    return cut.groupBy(*keys, "block_row", "block_col").applyInPandas(run, schema)


def gradient_scene(pixels: DataFrame, keys: list[str], band: str, sigma: float, *, size: int = 512, keep: tuple[str, ...] = (), extent: DataFrame | None = None) -> DataFrame:
    """(keys, x, y, ``keep``, gradient): ``kernels.gradient`` of the whole scene."""
    return over_scene(pixels, keys, [band], lambda a: kernels.gradient(a[0], sigma).astype(np.int32), "gradient", "int", halo=kernels.gradient_reach(sigma), size=size, keep=keep, extent=extent)


def maxima_scene(pixels: DataFrame, keys: list[str], value: str, reach: int, *, size: int = 512, keep: tuple[str, ...] = (), extent: DataFrame | None = None) -> DataFrame:
    """(keys, x, y, ``keep``, maximum: 0 or 1): ``kernels.maxima`` of the whole scene."""
    return over_scene(pixels, keys, [value], lambda a: kernels.maxima(a[0], reach).astype(np.int32), "maximum", "int", halo=reach, size=size, keep=keep, extent=extent)


def components_scene(pixels: DataFrame, keys: list[str], mask: str, *, diagonal: bool = False, size: int = 512, keep: tuple[str, ...] = (), extent: DataFrame | None = None) -> DataFrame:
    """(keys, x, y, ``keep``, component: long): connected pixels whose ``mask`` is not 0 (or null) have one number, their first pixel's x * columns + y; others have -1.

    Components of a block are named by their first pixels; pixels that touch across a border make an edge between two names. Only these meet in the
    graph, whose size is that of borders, and its least nodes are the scene's names.
    """

    def number(arrays: list[np.ndarray], top: int, left: int, cols: int) -> np.ndarray:
        found = kernels.components(arrays[0] != 0, diagonal)
        labels, at = np.unique(found, return_index=True)
        r, c = np.divmod(at, found.shape[1])
        names = (r + top).astype(np.int64) * cols + c + left
        names[labels == 0] = -1
        return names[np.searchsorted(labels, found)]

    local = staged(over_scene(pixels, keys, [mask], number, "node", "long", size=size, keep=keep, placed=True, extent=extent), "scene-components")
    there = local.where("node >= 0").select(*keys, "x", "y", "node")
    beside = (-1, 0, 1) if diagonal else (0,)

    def touching(along: str, across: str) -> DataFrame:
        """Pixels of a border's near side, sent on to the places that they touch on its far side."""
        near = there.where((F.col(across) + 1) % size == 0).select(*keys, F.col("node").alias("u"), (F.col(across) + 1).alias(across), F.explode(F.array(*[F.col(along) + o for o in beside])).alias(along))
        far = there.where(F.col(across) % size == 0).select(*keys, "x", "y", F.col("node").alias("v"))
        return near.join(far, [*keys, "x", "y"]).select(*keys, "u", "v")

    roots = connected(touching("y", "x").unionByName(touching("x", "y")), keys)
    named = local.where("node >= 0").join(roots, [*keys, "node"], "left").withColumn("component", F.coalesce("root", "node"))
    columns = [*keys, "x", "y", *keep, "component"]
    return named.select(*columns).unionByName(local.where("node < 0").withColumn("component", F.lit(-1).cast("long")).select(*columns))


def edges_scene(pixels: DataFrame, keys: list[str], band: str, sigma: float, low: float, high: float, *, size: int = 512, keep: tuple[str, ...] = (), extent: DataFrame | None = None) -> DataFrame:
    """(keys, x, y, ``keep``, edge: 0 or 1): ``kernels.edges`` of the whole scene. Ridges are local; what connects weak ones to strong ones is a component of the scene."""
    rows = over_scene(pixels, keys, [band], lambda a: kernels.ridges(a[0], sigma, low, high).astype(np.int32), "ridge", "int", halo=kernels.ridge_reach(sigma), size=size, keep=keep, extent=extent)
    found = staged(components_scene(rows, keys, "ridge", diagonal=True, size=size, keep=(*keep, "ridge"), extent=extent), "scene-edges")
    strong = found.where("ridge = 2").select(*keys, "component").distinct().withColumn("edge", F.lit(1))
    weak = found.where("component >= 0").join(strong, [*keys, "component"], "left").withColumn("edge", F.coalesce("edge", F.lit(0)))
    columns = [*keys, "x", "y", *keep, "edge"]
    return weak.select(*columns).unionByName(found.where("component < 0").withColumn("edge", F.lit(0)).select(*columns))


def distance_scene(pixels: DataFrame, keys: list[str], mask: str, *, keep: tuple[str, ...] = (), most: int = 1 << 18, extent: DataFrame | None = None) -> DataFrame:
    """(keys, x, y, ``keep``, distance: double): the Euclidean distance to the scene's nearest pixel whose ``mask`` is not 0; infinite without any.

    A scan down each column and one up it find the nearest in the column; then each row's lower envelope of parabolas finds the nearest of all. Both are linear
    in pixels. Columns are sorted, not held; rows are taken whole, as many at once as have some ``most`` places. Scenes with gaps are filled for the scans.
    """
    extent = staged(extents(pixels, keys), "scene-extents") if extent is None else extent
    columns = [*keys, "x", "y", *keep]
    rows = pixels.select(*columns, F.coalesce(F.col(mask) != 0, F.lit(False)).alias("_set"), F.lit(True).alias("_real"))
    sparse = extent.where(F.col("n") < F.col("rows").cast("long") * F.col("cols"))
    grid = sparse.select(*keys, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("x"), "cols").select(*keys, "x", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("y"))
    filled = rows.unionByName(grid.withColumns({"_set": F.lit(False), "_real": F.lit(False)}), allowMissingColumns=True)
    place = F.when(F.col("_set"), F.col("x"))
    upto = lambda order: Window.partitionBy(*keys, "y").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    above, below = F.last(place, ignorenulls=True).over(upto(F.col("x"))), F.last(place, ignorenulls=True).over(upto(F.desc("x")))
    near = F.least(F.col("x") - above, below - F.col("x"))  # of a null and another the other
    scanned = filled.withColumn("_near", near.cast("double"))
    strips = per_scene(scanned, extent.select(*keys, "cols"), keys).withColumn("_strip", F.floor(F.col("x") / F.greatest(F.floor(F.lit(most) / F.col("cols")), F.lit(1))))

    def across(group: pd.DataFrame) -> pd.DataFrame:
        first = group["x"].min()
        r, c = group["x"].to_numpy() - first, group["y"].to_numpy()
        heights = np.full((r.max() + 1, int(group["cols"].iloc[0])), np.inf)
        heights[r, c] = group["_near"].fillna(np.inf).to_numpy() ** 2
        own = group["_real"].to_numpy(bool)
        return group.loc[own, columns].assign(distance=np.sqrt(kernels.lower_envelope(heights))[r[own], c[own]])

    schema = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in columns) + ", distance double"
    return strips.select(*columns, "_near", "_real", "cols", "_strip").groupBy(*keys, "_strip").applyInPandas(across, schema)


def segments_scene(pixels: DataFrame, keys: list[str], bands: list[str], sensor: str = "srgb", *, size: int = 512, halo: int = 64) -> DataFrame:
    """``pixels`` with seg (long): watersheds whose markers are found over the whole scene, so a segment goes on across the borders of blocks.

    Edges, distances to them, their maxima and the maxima's components are the scene's own, whatever ``size``; a marker is named by its first pixel. Each block, with its ``halo``, is flooded from
    the markers in it: two blocks agree on a pixel if the floods that reach it start within their halos. A pixel that no marker in reach floods belongs to a segment of its block, named by
    the block's first pixel, below zero. A scene without data (first band 1 at most) is one segment, -1.
    """
    s = SENSORS[sensor]
    edge, slope = bands[s.edge_band], bands[s.gradient_band]
    keep = tuple(c for c in pixels.columns if c not in {*keys, "x", "y"})
    extent = staged(extents(pixels, keys), "scene-extents")
    local = {"size": size, "extent": extent}
    found = edges_scene(pixels, keys, edge, s.sigma, s.low, s.high, keep=keep, **local)
    far = distance_scene(found, keys, "edge", keep=keep, extent=extent)
    tops = maxima_scene(far, keys, "distance", s.spacing, keep=keep, **local)
    marked = components_scene(tops, keys, "maximum", keep=keep, **local)
    steep = staged(gradient_scene(marked, keys, slope, s.sigma, keep=(*keep, "component"), **local), "scene-slopes")

    def flood(arrays: list[np.ndarray], top: int, left: int, cols: int) -> np.ndarray:
        surface, marks = arrays[0].astype(int), arrays[1].astype(np.int64)  # names + 1, exact as floats
        names, local = np.unique(marks, return_inverse=True)
        local = local.reshape(marks.shape) if names[0] == 0 else local.reshape(marks.shape) + 1
        of = names if names[0] == 0 else np.concatenate([[0], names])
        out = of[kernels.watershed(surface, local)] - 1
        return np.where(out < 0, -(top * cols + left) - 2, out)

    steep = steep.withColumn("_mark", F.col("component") + 1)
    flooded = over_scene(steep, keys, ["gradient", "_mark"], flood, "seg", "long", halo=halo, keep=keep, placed=True, **local)
    empty = staged(steep.groupBy(*keys).agg((F.max(bands[0]) <= 1).alias("_empty")), "scene-empty")
    return per_scene(flooded, empty, keys).withColumn("seg", F.when(F.col("_empty"), F.lit(-1)).otherwise(F.col("seg"))).select(*pixels.columns, "seg")
