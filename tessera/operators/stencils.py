"""Stencils as DataFrame operations: what the array kernels compute, in relational form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DISK2 = tuple((dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if dx * dx + dy * dy <= 4)


def scharr(pixels: DataFrame, value: str) -> DataFrame:
    """(block, x, y, gx, gy): integer Scharr sums (3, 10, 3) of pixels with all eight neighbours in the block.

    Two windows: sums across rows of shifted sums down columns.
    """
    down, across = Window.partitionBy("block", "y").orderBy("x"), Window.partitionBy("block", "x").orderBy("y")
    up, low = F.lag(value).over(down), F.lead(value).over(down)
    part = pixels.select("block", "x", "y", (low - up).alias("d"), (3 * up + 10 * F.col(value) + 3 * low).alias("s"))
    gx = 3 * F.lag("d").over(across) + 10 * F.col("d") + 3 * F.lead("d").over(across)
    gy = F.lead("s").over(across) - F.lag("s").over(across)
    return part.select("block", "x", "y", gx.alias("gx"), gy.alias("gy")).where(F.col("gx").isNotNull() & F.col("gy").isNotNull())


def local_maxima(pixels: DataFrame, value: str, reach: int) -> DataFrame:
    """(block, x, y, value): pixels above 0 that none within ``reach`` rows and columns of their block exceeds."""
    down = Window.partitionBy("block", "y").orderBy("x").rangeBetween(-reach, reach)
    across = Window.partitionBy("block", "x").orderBy("y").rangeBetween(-reach, reach)
    best = pixels.select("block", "x", "y", F.col(value).alias("value"), F.max(value).over(down).alias("m"))
    return best.withColumn("m", F.max("m").over(across)).where((F.col("value") == F.col("m")) & (F.col("value") > 0)).select("block", "x", "y", "value")


def _spread(pixels: DataFrame, value: str, agg, shape: tuple[tuple[int, int], ...]) -> DataFrame:
    """Every pixel sends its value to the places around it; a place takes the least or largest that comes. A partial aggregate runs before the shuffle."""
    to = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in shape]))
    sent = pixels.select("block", F.col(value), to.alias("p")).groupBy("block", F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(agg(value).alias(value))
    return pixels.select("block", "x", "y").join(sent, ["block", "x", "y"])


def open_close(pixels: DataFrame, value: str, shape: tuple[tuple[int, int], ...] = DISK2) -> DataFrame:
    """(block, x, y, value) after opening (least, then largest) and closing (largest, then least) with a disk."""
    out = pixels.select("block", "x", "y", value)
    for agg in (F.min, F.max, F.max, F.min):
        out = _spread(out, value, agg, shape)
    return out
