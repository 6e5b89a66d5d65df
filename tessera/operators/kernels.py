"""Array kernels of a block: spectra, edges, distances and watersheds. numpy in tasks; Spark deals blocks out.

A block is at most ``MOST_PIXELS`` (its size is a parameter of tiling), so a group is bounded; larger ones are refused.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.model import SENSORS, Sensor

MOST_PIXELS = 1 << 20


def quality_score(band: np.ndarray) -> float:
    """Share of the spectrum above a hundred thousandth of its largest magnitude.

    Complex numbers are compared as numpy orders them: by real part, then by imaginary part.
    """
    spectrum = np.fft.fft2(band)
    return float(np.count_nonzero(spectrum > np.abs(spectrum).max() / 1e5) / spectrum.size)


def smooth(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian of radius 4 sigma, mirrored at the borders, along one axis and then the other."""
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = image.astype(float)
    for axis in (0, 1):
        padded = np.pad(out, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        out = sum(w * np.take(padded, range(k, k + out.shape[axis]), axis) for k, w in enumerate(weights))
    return out


def _slopes(image: np.ndarray, side: float, middle: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column derivatives of a 3 x 3 stencil, weights adding up to 1 on each side, mirrored at the borders."""
    p = np.pad(image, 1, mode="symmetric")
    across = lambda q: side * q[:, :-2] + middle * q[:, 1:-1] + side * q[:, 2:]
    down = across(p)
    rows = (down[2:] - down[:-2]) / 2
    beside = across(p.T)
    return rows, ((beside[2:] - beside[:-2]) / 2).T


def gradient(band: np.ndarray, sigma: float) -> np.ndarray:
    """Scharr magnitude of the smoothed band, 0 to 255, with border lines as their inner neighbours."""
    rows, cols = _slopes(smooth(band, sigma), 3 / 16, 10 / 16)
    out = np.minimum(np.sqrt((rows**2 + cols**2) / 2), 255).astype(np.uint8)
    if min(out.shape) > 1:
        out[:, 0], out[:, -1] = out[:, 1], out[:, -2]
        out[0, :], out[-1, :] = out[1, :], out[-2, :]
    return out


def ridges(band: np.ndarray, sigma: float, low: float, high: float) -> np.ndarray:
    """Canny before pixels are connected: ridges of the smoothed band's gradient, 1 over ``low`` and 2 over ``high``; 0 elsewhere.

    A pixel depends on those within ``ridge_reach(sigma)`` rows and columns alone.
    """
    rows, cols = _slopes(smooth(band, sigma), 1 / 4, 1 / 2)
    size = np.hypot(rows * 8 / 4, cols * 8 / 4)
    p = np.pad(size, 1)
    inner = lambda dr, dc: p[1 + dr : p.shape[0] - 1 + dr, 1 + dc : p.shape[1] - 1 + dc]
    direction = np.round(np.arctan2(rows, cols) / (np.pi / 4)).astype(int) % 4
    ridge = np.zeros(size.shape, bool)
    for d, (dr, dc) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ridge |= (direction == d) & (size >= inner(dr, dc)) & (size > inner(-dr, -dc))
    return np.where(ridge & (size >= low), np.where(size >= high, 2, 1), 0)


def gradient_reach(sigma: float) -> int:
    """How far a pixel's gradient looks: smoothing, the stencil, and a border line's inner neighbour."""
    return int(4 * sigma + 0.5) + 2


def ridge_reach(sigma: float) -> int:
    """How far a pixel's ridge looks: smoothing, the stencil, and the neighbours that it is compared with."""
    return int(4 * sigma + 0.5) + 2


def edges(band: np.ndarray, sigma: float, low: float, high: float) -> np.ndarray:
    """Canny: ridges of the smoothed band's gradient over ``low``, connected to one over ``high``."""
    found = ridges(band, sigma, low, high)
    numbers = components(found > 0, diagonal=True)
    strong = np.unique(numbers[found == 2])
    return (found > 0) & np.isin(numbers, strong)


def lower_envelope(heights: np.ndarray) -> np.ndarray:
    """For each place i of each row the least of heights[j] + (i - j)^2, in linear time (Felzenszwalb, Huttenlocher 2012); inf where a row has none.

    Parabolas are pushed on, and popped off, a stack for each row; all rows go together, a column at a time.
    """
    rows, cols = heights.shape
    root, start = np.zeros((rows, cols + 1), int), np.full((rows, cols + 2), np.inf)
    top, every = np.full(rows, -1), np.arange(rows)
    lifted = heights + np.arange(cols) ** 2.0
    for q in range(cols):
        mine = every[np.isfinite(heights[:, q])]
        where = np.full(len(mine), -np.inf)
        open_ = np.flatnonzero(top[mine] >= 0)
        while len(open_):
            at = mine[open_]
            v = root[at, top[at]]
            where[open_] = (lifted[at, q] - lifted[at, v]) / (2.0 * (q - v))
            hidden = where[open_] <= start[at, top[at]]
            top[at[hidden]] -= 1
            open_ = open_[hidden]
            emptied = top[mine[open_]] < 0
            where[open_[emptied]] = -np.inf
            open_ = open_[~emptied]
        top[mine] += 1
        root[mine, top[mine]], start[mine, top[mine]], start[mine, top[mine] + 1] = q, where, np.inf
    out = np.full((rows, cols), np.inf)
    mine = every[top >= 0]
    at = np.zeros(len(mine), int)
    for q in range(cols):
        while (behind := start[mine, at + 1] < q).any():
            at += behind
        v = root[mine, at]
        out[mine, q] = heights[mine, v] + (q - v) ** 2.0
    return out


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance to the nearest set pixel: least distances along columns, then the lower envelope along rows. inf without any."""
    rows, cols = mask.shape
    near = np.where(mask, 0.0, np.inf)
    for r in range(1, rows):
        near[r] = np.minimum(near[r], near[r - 1] + 1)
    for r in range(rows - 2, -1, -1):
        near[r] = np.minimum(near[r], near[r + 1] + 1)
    return np.sqrt(lower_envelope(near**2))


def maxima(image: np.ndarray, reach: int) -> np.ndarray:
    """Pixels, above 0, that no pixel within ``reach`` rows and columns exceeds."""
    best = image
    for axis in (0, 1):
        padded = np.pad(best, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
        best = np.max([np.take(padded, range(k, k + image.shape[axis]), axis) for k in range(2 * reach + 1)], axis=0)
    return (image == best) & (image > 0)


def components(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Numbers from 1 of connected set pixels, in order of their first pixel; 0 elsewhere. Labels spread by minima and pointer jumps."""
    rows, cols = mask.shape
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    parent = np.arange(mask.size + 1)
    while True:
        before = parent.copy()
        for dr, dc in steps:
            a = label[: rows - dr, max(0, -dc) : cols - max(0, dc)].ravel()
            b = label[dr:, max(0, dc) : cols + min(0, dc)].ravel()
            both = (a > 0) & (b > 0)
            least = np.minimum(parent[a[both]], parent[b[both]])
            np.minimum.at(parent, parent[a[both]], least)
            np.minimum.at(parent, parent[b[both]], least)
        parent = parent[parent]
        if (parent == before).all():
            break
    roots = parent[label]
    names = np.unique(roots[roots > 0])
    return np.where(mask, np.searchsorted(names, roots) + 1, 0)


def watershed(surface: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Floods ``surface`` from ``markers``: the lowest reached pixel next, of equals the one reached first. Pixels that no marker reaches stay 0.

    Levels are queues, and a level's queue is taken as whole frontiers: all that a frontier reaches comes behind it, in its order and that of
    the four neighbours, so nothing depends on taking pixels one by one. What lies higher waits in its own level's queue.
    """
    rows, cols = surface.shape
    width = cols + 2
    levels, rank = np.unique(surface, return_inverse=True)
    height = np.pad(rank.reshape(surface.shape), 1).ravel()
    out = np.pad(markers, 1, constant_values=-1).ravel()
    steps = np.array([-width, -1, 1, width])
    first = np.zeros(out.size, int)
    queues: list[list[np.ndarray]] = [[] for _ in levels]

    def wait(pixels: np.ndarray) -> None:
        """In order, behind what waits at their levels."""
        by_level = np.argsort(height[pixels], kind="stable")
        pixels = pixels[by_level]
        cuts = np.flatnonzero(np.diff(height[pixels])) + 1
        for part in np.split(pixels, cuts):
            if len(part):
                queues[height[part[0]]].append(part)

    wait(np.flatnonzero(out > 0))
    for level in range(len(levels)):
        front = np.concatenate(queues[level]) if queues[level] else np.zeros(0, int)
        queues[level] = []
        while len(front):
            reached = (front[:, None] + steps).ravel()
            source = np.repeat(front, 4)
            free = out[reached] == 0
            reached, source = reached[free], source[free]
            order = np.arange(len(reached))
            first[reached[::-1]] = order[::-1]  # of those that reach a pixel the first, which is written last
            won = first[reached] == order
            reached = reached[won]
            out[reached] = out[source[won]]
            higher = height[reached] > level
            if higher.any():
                wait(reached[higher])
            front = reached[~higher]
    return out.reshape(rows + 2, width)[1:-1, 1:-1]


def segment(bands: list[np.ndarray], sensor: Sensor) -> np.ndarray:
    """Segment numbers of a block: watersheds of the gradient from places far from edges. A block without data is one segment, 0."""
    if bands[0].max(initial=0) <= 1:
        return np.zeros(bands[0].shape, int)
    found = edges(bands[sensor.edge_band], sensor.sigma, sensor.low, sensor.high)
    far = distance_to(found) if found.any() else np.ones(bands[0].shape)
    return watershed(gradient(bands[sensor.gradient_band], sensor.sigma).astype(int), components(maxima(far, sensor.spacing)))


def block_arrays(group: pd.DataFrame, bands: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A block's bands as arrays, 0 where there is no pixel, and its pixels' places in them."""
    r, c = group["x"].to_numpy() - group["x"].min(), group["y"].to_numpy() - group["y"].min()
    if (r.max() + 1) * (c.max() + 1) > MOST_PIXELS:
        raise ValueError(f"a block of {r.max() + 1} x {c.max() + 1} pixels is more than the {MOST_PIXELS} that a kernel takes: tile the scene finer")
    out = []
    for b in bands:
        array = np.zeros((r.max() + 1, c.max() + 1))
        array[r, c] = group[b].fillna(0).to_numpy()
        out.append(array)
    return out, r, c


def per_pixel(pixels: DataFrame, bands: list[str], kernel: Callable[[list[np.ndarray]], np.ndarray], name: str, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(block, x, y, ``keep``, ``name``): a kernel's array, for every pixel of each block, with columns of the pixels to keep."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        arrays, r, c = block_arrays(group, bands)
        return group[["block", "x", "y", *keep]].assign(**{name: kernel(arrays)[r, c]})

    of = lambda c: f"{c} {pixels.schema[c].dataType.simpleString()}"
    columns = ["block", "x", "y", *keep]
    return pixels.select(*dict.fromkeys([*columns, *bands])).groupBy("block").applyInPandas(run, ", ".join(map(of, columns)) + f", {name} {kind}")


def block_quality(pixels: DataFrame, band: str = "b0", keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, block, score): the quality score of each block, with columns that are the same all over it."""
    columns = [*keep, "block"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        (array,), _, _ = block_arrays(group, [band])
        return group[columns].iloc[:1].assign(score=quality_score(array))

    schema = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in columns) + ", score double"
    return pixels.select(*columns, "x", "y", band).groupBy("block").applyInPandas(run, schema)


def segment_blocks(pixels: DataFrame, bands: list[str], sensor: str = "srgb", keep: tuple[str, ...] = ()) -> DataFrame:
    """(block, x, y, ``keep``, seg): segments of every block, by the sensor's parameters."""
    params = SENSORS[sensor]
    return per_pixel(pixels, bands, lambda arrays: segment(arrays, params), "seg", "int", keep)


def neighbour_counts(pixels: DataFrame, mode: str = "literal", value: str = "b1", height: int | str | None = None) -> DataFrame:
    """(block, seg, v, c): values of the pixels around segments, as ``segments.neighbours`` meets them, counted.

    For blocks of a known size: rows and columns 3 and 4 away are slices of the block's arrays, so there is no join. Places without a pixel are never met.
    ``height``: the number of a block's rows, one for all or a column, if its first or last may be without pixels; ``x % height`` is then a pixel's row in its block.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        (first, values, seg), r, c = block_arrays(group, ["b0", value, "seg"])
        there = np.zeros(first.shape, bool)
        there[r, c] = True
        rows, cols = first.shape
        tall = rows if height is None else int(group[height].iloc[0]) if isinstance(height, str) else height
        lowest = 0 if height is None else int(group["x"].min()) % tall
        pairs = []
        for o in (-4, -3, 3, 4):
            for down, across in ((o, 0), (0, o)):
                tops, sides = max(0, rows - abs(down)), max(0, cols - abs(across))  # none, where a block is smaller than the offset
                a = (slice(max(0, -down), max(0, -down) + tops), slice(max(0, -across), max(0, -across) + sides))
                b = (slice(max(0, down), max(0, down) + tops), slice(max(0, across), max(0, across) + sides))
                met = there[a] & there[b] & (first[a] != 0) & (seg[b] != (0 if mode == "training" else seg[a]))
                if across and mode != "clean":  # columns are probed only where the row at that offset is in the block
                    row = np.arange(rows)[a[0]][:, None] + o + lowest
                    met &= (row >= 0) & (row < tall)
                pairs.append(np.column_stack([seg[a][met], values[b][met]]))
        found, count = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        return pd.DataFrame({"block": group["block"].iloc[0], "seg": found[:, 0].astype(int), "v": found[:, 1].astype(int), "c": count})

    kind = pixels.schema["block"].dataType.simpleString()
    columns = ["block", "x", "y", "b0", value, "seg", *([height] if isinstance(height, str) else [])]
    return pixels.select(*dict.fromkeys(columns)).groupBy("block").applyInPandas(run, f"block {kind}, seg int, v int, c long")
