"""Rasters read by windows and written by tiles."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import rasters


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rasters.register(spark)
    top = tmp_path_factory.mktemp("scenes")
    rng = np.random.default_rng(12)
    arrays = {}
    for name, kind, interleave in (("one", "<u1", "bsq"), ("two", ">u2", "bil"), ("three", "<i2", "bip")):
        array = rng.integers(0, 250, (3, 70, 45)).astype(kind)
        arrays[name] = array
        order = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[interleave]
        (top / f"{name}.bsq").write_bytes(b"head" + array.transpose(order).tobytes())
        (top / f"{name}.hdr").write_text(rasters.Header(70, 45, 3, kind, 4, interleave).text())
    return str(top), arrays


def _arrays(frame, shape):
    out = np.full(shape, -1)
    for r in frame.collect():
        out[:, r.x, r.y] = [r[f"b{k}"] for k in range(shape[0])]
    return out


def test_scenes_come_back(spark, folder):
    path, arrays = folder
    frame = spark.read.format("raster").option("block", 32).option("bands", 3).load(path)
    assert frame.rdd.getNumPartitions() == 3 * 3 * 2 and frame.count() == 3 * 70 * 45
    for name, array in arrays.items():
        assert (_arrays(frame.where(F.col("image_id") == name), array.shape) == array).all()
    assert frame.where("x div 32 <> block_row or y div 32 <> block_col").count() == 0


def test_only_windows_and_bands_that_are_asked_for_are_read(spark, folder):
    path, arrays = folder
    few = spark.read.format("raster").option("block", 16).schema("image_id string, x int, y int, b1 int").load(path).where("image_id = 'one' and x >= 20 and x < 30 and y = 3")
    assert few.rdd.getNumPartitions() == 1
    assert {(r.x, r.b1) for r in few.collect()} == {(x, int(arrays["one"][1, x, 3])) for x in range(20, 30)}
    header = rasters.Header(70, 45, 3, "<u1")
    assert sum(n for _, n, _, _ in header.spans([1], 20, 3, 10, 1)) == 10  # samples
    assert spark.read.format("raster").load(path).where("x > 900").count() == 0
    with pytest.raises(Exception, match="no bands"):
        spark.read.format("raster").schema("b7 int").load(path).collect()


def test_tiles_are_written_and_read_again(spark, folder, tmp_path):
    path, arrays = folder
    frame = spark.read.format("raster").option("block", 32).option("bands", 3).load(path)
    out = str(tmp_path / "tiles")
    os.makedirs(out)
    for _ in range(2):  # the second takes the first one's place
        rasters.by_tile(frame).write.format("raster").option("kind", "u2").mode("overwrite").save(out)
    assert len(os.listdir(out)) == 2 * 18 and not [n for n in os.listdir(out) if n.startswith("_")]
    again = spark.read.format("raster").option("block", 50).option("bands", 3).load(out)
    for name, array in arrays.items():
        assert (_arrays(again.where(F.col("image_id") == name), array.shape) == array).all()


def test_a_task_that_fails_leaves_nothing(spark, folder, tmp_path):
    path, _ = folder
    out = str(tmp_path / "tiles")
    os.makedirs(out)
    frame = rasters.by_tile(spark.read.format("raster").option("block", 32).load(path))
    for wrong in (frame.withColumn("b0", F.when(F.col("image_id") == "two", F.lit(70_000)).otherwise(F.col("b0"))), frame.orderBy("y", "x")):
        with pytest.raises(Exception, match="do not fit|together|more than one"):
            wrong.write.format("raster").mode("append").save(out)
        assert os.listdir(out) == []


def test_headers():
    header = rasters.Header(5, 6, 2, ">u2", 8, "bil", 100, 200)
    assert rasters.Header.parse(header.text()) == header
    with pytest.raises(ValueError, match="data type"):
        rasters.Header.parse("ENVI\nsamples = 1\nlines = 1\nbands = 1\ndata type = 6\n")
