"""Blocks of scenes: their sizes, their grid, and moving pixels between block and scene coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import DISPLAY_BANDS, RAW_DISPLAY_BANDS
from tessera.operators.ordered import numbered

#: Tables of a row for each scene are broadcast up to so many rows.
MOST_SCENES = 100_000


def block_size(dim: Column, desired: int, step: int = 256) -> Column:
    """The first of desired, desired + step, ... that leaves of ``dim`` a rest of over half a block; ``dim`` at most.

    A block of ``dim`` itself leaves no rest, and two thirds of it is enough to look to: sizes above ``dim`` leave ``dim``.
    """
    sizes = F.sequence(F.lit(desired), dim * 2 + desired + step, F.lit(step))
    fit = F.filter(sizes, lambda s: (dim % s) * 2 > s)
    return F.least(F.coalesce(F.array_min(fit), dim), dim).cast("int")


def block_sizes(scenes: DataFrame, desired: int = 6400) -> DataFrame:
    """``scenes`` (x_dim, y_dim) with block_x and block_y; a scene no larger than ``desired`` either way is one block."""
    whole = (F.col("x_dim") <= desired) | (F.col("y_dim") <= desired)
    size = lambda d: F.when(whole, F.col(d)).otherwise(block_size(F.col(d), desired)).cast("int")
    return scenes.withColumns({"block_x": size("x_dim"), "block_y": size("y_dim")})


def block_grid(scenes: DataFrame) -> DataFrame:
    """A row for each block of each scene (x, y, w, h; y outer): two generators, no join; the last of a line is clipped."""
    rows = scenes.withColumn("y", F.explode(F.expr("sequence(0, y_dim - 1, block_y)")))
    cells = rows.withColumn("x", F.explode(F.expr("sequence(0, x_dim - 1, block_x)")))
    return cells.withColumns({"w": F.least("block_x", F.col("x_dim") - F.col("x")), "h": F.least("block_y", F.col("y_dim") - F.col("y"))})


def assign_blocks(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """Pixels with block_row and block_col, and their place in the block."""
    return pixels.withColumns({
        "block_row": F.floor(F.col("x") / rows).cast("int"), "block_col": F.floor(F.col("y") / cols).cast("int"), "r": F.col("x") % rows, "c": F.col("y") % cols,
    })


def mosaic(pixels: DataFrame, tiles: DataFrame, tile_rows: int, tile_cols: int, by: str = "name") -> DataFrame:
    """Pixels (tile, r, c, ...) of equal tiles in scene coordinates; tiles (tile, ``by``) fill a square, row by row, in order of ``by``.

    Without a square number of tiles there is no mosaic: the result is empty. The list of tiles, a row for
    each file, is numbered; pixels are mapped through a join with it.
    """
    listed = numbered(tiles, by, "n").join(F.broadcast(tiles.agg(F.count("*").alias("tiles"))))
    side = F.sqrt("tiles").cast("int")
    placed = listed.where(side * side == F.col("tiles")).select("tile", F.floor(F.col("n") / side).cast("int").alias("tr"), (F.col("n") % side).alias("tc"))
    return pixels.join(placed, "tile").withColumns({"x": F.col("tr") * tile_rows + F.col("r"), "y": F.col("tc") * tile_cols + F.col("c")}).drop("tr", "tc")


def downsample(pixels: DataFrame, factor: int, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """Every pixel with ``mean``: that of all bands over its ``factor`` x ``factor`` cell; places outside the raster count as 0."""
    cell = {"cell_x": F.floor(F.col("x") / factor).cast("int"), "cell_y": F.floor(F.col("y") / factor).cast("int")}
    on = [*(keys or []), "cell_x", "cell_y"]
    keyed = pixels.withColumns(cell)
    total = sum((F.col(b) for b in bands[1:]), F.col(bands[0]))
    means = keyed.groupBy(*on).agg((F.sum(total) / F.lit(float(len(bands) * factor * factor))).alias("mean"))
    return keyed.join(means, on)


def composite(pixels: DataFrame, bands: list[str], names: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    return pixels.select("x", "y", *(F.col(b).alias(n) for b, n in zip(bands, names)))


def display(pixels: DataFrame, sensor: str) -> DataFrame:
    """The bands of a sensor that are shown as red, green and blue; a single band is all three."""
    return composite(pixels, [f"b{k}" for k in DISPLAY_BANDS[sensor]])


def raw_display(pixels: DataFrame, sensor: str) -> DataFrame:
    """The bands of a raw scene of a sensor that are drawn as red, green and blue."""
    return composite(pixels, [f"b{k}" for k in RAW_DISPLAY_BANDS[sensor]])


def band_arrays(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """(x, y, bands): wide bands, one or more, as an array with one place a band."""
    return pixels.select("x", "y", F.array(*bands).alias("bands"))


def extents(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, cols, n): how far each scene goes, and how many pixels it has."""
    return pixels.groupBy(*keys).agg((F.max("x") + 1).alias("rows"), (F.max("y") + 1).alias("cols"), F.count("*").alias("n"))


def per_scene(pixels: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``pixels`` with the columns of ``table``, a row for each scene: broadcast, so pixels stay where they are, unless there are more than ``MOST_SCENES`` of them."""
    few = table.limit(MOST_SCENES + 1).count() <= MOST_SCENES
    return pixels.join(F.broadcast(table) if few else table, keys, how)
