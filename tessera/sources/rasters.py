"""Uncompressed rasters (a text header beside a file of samples) read by windows and written by tiles, as a Spark data source.

``register(spark)``, then ``spark.read.format("raster")`` and ``df.write.format("raster")``. A header is ENVI's: ``samples``, ``lines``, ``bands``,
``header offset``, ``data type``, ``interleave`` and ``byte order``, and here ``x start`` and ``y start`` for a raster that is a part of a scene.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Codes of ENVI data types.
SAMPLES = {1: "u1", 2: "i2", 3: "i4", 12: "u2", 13: "u4"}
_PLACES = ("image_id", "block_row", "block_col", "x", "y")


def _filesystem(path: str):
    """A path's file system, wherever Arrow finds one, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    """How a file's samples lie. ``top`` and ``left``: the scene's place of the first."""

    rows: int
    cols: int
    bands: int
    kind: str
    offset: int = 0
    interleave: str = "bsq"
    top: int = 0
    left: int = 0

    @staticmethod
    def parse(text: str) -> Header:
        values = {k.strip().lower(): v.strip() for k, _, v in (line.partition("=") for line in text.splitlines()) if v}
        number = lambda name, default=None: int(values.get(name, default))
        if (code := number("data type")) not in SAMPLES or values.get("interleave", "bsq").lower() not in ("bsq", "bil", "bip"):
            raise ValueError(f"rasters of data type {code}, interleaved {values.get('interleave')}, are not read")
        kind = (">" if number("byte order", 0) else "<") + SAMPLES[code]
        return Header(number("lines"), number("samples"), number("bands"), kind, number("header offset", 0), values.get("interleave", "bsq").lower(), number("y start", 0), number("x start", 0))

    def text(self) -> str:
        code = next(c for c, kind in SAMPLES.items() if kind == self.kind[1:])
        lines = {
            "samples": self.cols, "lines": self.rows, "bands": self.bands, "header offset": self.offset, "data type": code, "interleave": self.interleave,
            "byte order": int(self.kind[0] == ">"), "x start": self.left, "y start": self.top,
        }
        return "ENVI\n" + "".join(f"{k} = {v}\n" for k, v in lines.items())

    def spans(self, bands: list[int], top: int, left: int, rows: int, cols: int) -> Iterator[tuple[int, int, int, int]]:
        """(byte, samples, band or -1, row) of the runs of samples that a window of these bands lies in; a run of all bands (-1) is interleaved by pixel."""
        for r in range(top, top + rows):
            if self.interleave == "bip":
                yield (r * self.cols + left) * self.bands, cols * self.bands, -1, r - top
            else:
                for b in bands:
                    line = (b * self.rows + r) if self.interleave == "bsq" else (r * self.bands + b)
                    yield line * self.cols + left, cols, b, r - top

    def window(self, samples, bands: list[int], top: int, left: int, rows: int, cols: int) -> dict[int, np.ndarray]:
        """Arrays of some bands over a window (in the file's own rows and columns); no other samples are read, but with bands interleaved by pixel."""
        size, out = np.dtype(self.kind).itemsize, {b: np.zeros((rows, cols), np.int64) for b in bands}
        for at, count, band, row in self.spans(bands, top, left, rows, cols) if bands else ():
            samples.seek(self.offset + at * size)
            values = np.frombuffer(samples.read(count * size), self.kind)
            if len(values) != count:
                raise ValueError("a raster's file is shorter than its header says")
            for b in bands:
                if band in (b, -1):
                    out[b][row] = values if band == b else values[b :: self.bands]
        return out


@dataclass
class Window(InputPartition):
    """A block of a file: what a task reads."""

    path: str
    header: Header
    image: str
    block_row: int
    block_col: int
    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.path, self.block = schema.names, options["path"], int(options.get("block", 512))
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}
        self.images: set[str] | None = None

    def pushFilters(self, filters):
        """Bounds of places, and images by name, choose windows; everything else, and bounds too, Spark checks again on the rows."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "image_id" and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.images = named if self.images is None else self.images & named
            elif name in _PLACES[1:] and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low.get(name, 0), f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high.get(name, f.value), f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Window]:
        from pyarrow import fs

        system, path = _filesystem(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".hdr") and "/_" not in f.path[len(path) :]]
        out = []
        for file in sorted(found, key=lambda f: f.path):
            with system.open_input_stream(file.path) as text:
                header = Header.parse(text.read().decode())
            image = re.sub(r"(\.tile_\d+_\d+)?\.hdr$", "", file.path.rsplit("/", 1)[1])
            if self.images is not None and image not in self.images:
                continue
            first = lambda at: at // self.block
            for row in range(first(header.top), first(header.top + header.rows - 1) + 1):
                for col in range(first(header.left), first(header.left + header.cols - 1) + 1):
                    window = Window(file.path[: -len(".hdr")] + ".bsq", header, image, row, col, self.low, self.high)
                    if all(a < b for a, b in self.extent(window)):
                        out.append(window)
        return out

    def extent(self, w: Window) -> tuple[tuple[int, int], tuple[int, int]]:
        """(first, end) of a window's rows and columns in the scene, within its file and the bounds asked for."""
        out = []
        for place, block, number, start, size in (("x", w.block_row, "block_row", w.header.top, w.header.rows), ("y", w.block_col, "block_col", w.header.left, w.header.cols)):
            low = max(block * self.block, start, w.low.get(place, 0))
            high = min((block + 1) * self.block, start + size, w.high.get(place, start + size) + 1)
            out.append((low, high if w.low.get(number, 0) <= block <= w.high.get(number, block) else low))
        return tuple(out)

    def read(self, partition: Window | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no windows
            return
        (top, bottom), (left, right) = self.extent(partition)
        shape = bottom - top, right - left
        header, bands = partition.header, [int(n[1:]) for n in self.names if n not in _PLACES]
        if missing := [b for b in bands if b >= header.bands]:
            raise ValueError(f"{partition.image} has no bands {missing}")
        system, _ = _filesystem(self.path)
        with system.open_input_file(partition.path) as samples:
            arrays = header.window(samples, bands, top - header.top, left - header.left, *shape)
        x, y = np.mgrid[top:bottom, left:right]
        columns = {"x": x, "y": y, "block_row": np.full(shape, partition.block_row), "block_col": np.full(shape, partition.block_col)} | {f"b{b}": a for b, a in arrays.items()}
        made = [pa.array([partition.image] * x.size) if n == "image_id" else pa.array(columns[n].ravel().astype(np.int32)) for n in self.names]
        yield pa.RecordBatch.from_arrays(made, self.names)


@dataclass
class Tiles(WriterCommitMessage):
    """Tiles that a task has written: their files, and what they are to be called."""

    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.names, self.path, self.kind, self.overwrite = schema.names, options["path"], options.get("kind", "u1"), overwrite
        self.bands = [n for n in self.names if n not in _PLACES]
        self.job = uuid.uuid4().hex
        if missing := [n for n in _PLACES if n not in self.names]:
            raise ValueError(f"tiles need {', '.join(missing)}")

    def pending(self) -> str:
        return f"{_filesystem(self.path)[1]}/_pending-{self.job}"

    def write(self, rows: Iterator) -> Tiles:
        """A file for each tile, under a name that no other attempt has. Rows of a tile come together (``by_tile``): only one is held at a time."""
        system, folder = _filesystem(self.path)[0], self.pending()
        system.create_dir(folder, recursive=True)
        files, seen = [], set()
        for tile, group in groupby(rows, key=lambda r: (r["image_id"], r["block_row"], r["block_col"])):
            if tile in seen:
                raise ValueError("rows of a tile have to come together: write by_tile(...)")
            seen.add(tile)
            values = np.array([[r["x"], r["y"], *(r[b] or 0 for b in self.bands)] for r in group], np.int64)
            (top, left), (bottom, right) = values[:, :2].min(axis=0), values[:, :2].max(axis=0)
            array = np.zeros((len(self.bands), bottom - top + 1, right - left + 1), np.int64)
            array[:, values[:, 0] - top, values[:, 1] - left] = values[:, 2:].T
            if (array != array.astype(self.kind)).any():
                raise ValueError(f"values do not fit samples of {self.kind}")
            header = Header(array.shape[1], array.shape[2], len(self.bands), "<" + self.kind, top=int(top), left=int(left))
            name = f"{folder}/{uuid.uuid4().hex}"
            for end, data in ((".bsq", array.astype("<" + self.kind).tobytes()), (".hdr", header.text().encode())):
                with system.open_output_stream(name + end) as out:
                    out.write(data)
            files.append((name, "{}.tile_{}_{}".format(*tile)))
        return Tiles(files)

    def commit(self, messages: list[Tiles | None]) -> None:
        """Gives the files of successful attempts their names, samples before headers, which readers go by; what else was written goes."""
        system, folder = _filesystem(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of a tile are in more than one task: write by_tile(...)")
        if self.overwrite:
            from pyarrow import fs

            for old in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if old.path.endswith((".hdr", ".bsq")):
                    system.delete_file(old.path)
        for end in (".bsq", ".hdr"):
            for file, name in files:
                system.move(file + end, f"{folder}/{name}{end}")
        self.abort(messages)

    def abort(self, messages: list[Tiles | None]) -> None:
        system, folder = _filesystem(self.path)[0], self.pending()
        if system.get_file_info(folder).type.name == "Directory":
            system.delete_dir(folder)


class RasterSource(DataSource):
    """Rasters of a folder. Options: ``path``, ``block`` (pixels each way of a window, which is a task), ``bands`` (columns b0, b1, ... where no schema is given), ``kind`` (samples to write, as u1 or i2).

    A schema names the columns to read, of image_id, block_row, block_col, x (row), y (column) and bands: bands that it leaves out are not read.
    """

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> StructType:
        bands = [f"b{k}" for k in range(int(self.options.get("bands", 1)))]
        return StructType([StructField(n, StringType() if n == "image_id" else IntegerType()) for n in (*_PLACES, *bands)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``raster`` a format of the session, and has Spark tell Python sources what it filters by."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


def by_tile(pixels):
    """Pixels (image_id, block_row, block_col, x, y, bands) so that each tile is in one task, in one piece."""
    tile = ("image_id", "block_row", "block_col")
    return pixels.repartition(*tile).sortWithinPartitions(*tile)
