"""Hand-sized cases: traps of neighbourhoods, stretches, blocks, updates, files and streams."""

from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import classify, radiometry, segments, stencils, tiling, training
from tessera.sources import images, sinks
from tessera.streaming import drop_folder


def test_stretch_keeps_zero_and_spans_1_to_255(spark):
    rows = spark.range(256).select(F.col("id").cast("int").alias("v"))
    out = [r[0] for r in rows.select(radiometry.stretch(F.col("v"), F.lit(40), F.lit(200))).collect()]
    assert out[0] == 0 and out[1] == 1 and out[200] == 255 and out[255] == 255 and out[1:] == sorted(out[1:])
    assert rows.limit(2).select(radiometry.stretch(F.col("v"), F.lit(9), F.lit(9))).collect()[1][0] is None


def test_white_balance(spark):
    out = spark.createDataFrame([(0,), (1,), (250,), (None,)], "v int").select(radiometry.white_balance(F.col("v"), F.lit(100), F.lit(200)), radiometry.white_balance(F.col("v"), F.lit(0), F.lit(200))).collect()
    assert [tuple(r) for r in out] == [(0, 0), (2, None), (255, None), (None, None)]


def _grid(spark, h, w, seg):
    return spark.createDataFrame([(0, x, y, seg(x, y), 1 + x * w + y) for x in range(h) for y in range(w)], "block int, x int, y int, seg int, b0 int").withColumns({"b1": F.col("b0"), "b2": F.col("b0")})


def test_neighbours_against_loops(spark):
    h, w = 9, 8
    seg = lambda x, y: (x // 5) * 2 + y // 4
    grid = _grid(spark, h, w, seg)

    def loops(mode):
        out = []
        for x in range(h):
            for y in range(w):
                for o in (-4, -3, 3, 4):
                    row = 0 <= x + o < h
                    if row and seg(x + o, y) != (0 if mode == "training" else seg(x, y)):
                        out.append((seg(x, y), 1 + (x + o) * w + y))
                    if 0 <= y + o < w and (row or mode == "clean") and seg(x, y + o) != (0 if mode == "training" else seg(x, y)):
                        out.append((seg(x, y), 1 + x * w + y + o))
        return sorted(out)

    for mode in ("literal", "clean", "training"):
        assert sorted((r.seg, r.b1) for r in segments.neighbours(grid, h, w, mode).collect()) == loops(mode)
    assert sorted((r.seg, r.b1) for r in segments.neighbours_by_window(grid).collect()) == loops("clean")


def test_entropy_and_empty_input(spark):
    even = spark.createDataFrame([(0, 0, v) for v in range(8)], "block int, seg int, v int")
    assert segments.entropy(segments.value_counts(even, "v")).first().entropy == 3
    assert segments.features_srgb(_grid(spark, 2, 2, lambda x, y: 0).where("b0 < 0"), 2, 2).count() == 0


def test_blocks_tile_a_scene(spark):
    scenes = spark.createDataFrame([(13000, 12900), (50, 70)], "x_dim int, y_dim int")
    grid = tiling.block_grid(tiling.block_sizes(scenes))
    area = {r.x_dim: r.area for r in grid.groupBy("x_dim").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("area")).collect()}
    assert area == {13000: 13000 * 12900, 50: 3500}


def test_mosaic_needs_a_square(spark):
    tiles = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "tile int, name string")
    pixels = spark.createDataFrame([(i, 0, 0) for i in range(3)], "tile int, r int, c int")
    assert tiling.mosaic(pixels, tiles, 1, 1).count() == 0


def test_percent_and_report(spark):
    painted = spark.createDataFrame([("a", c) for c in (0, 1, 1, 4)], "image_id string, cls int")
    percent = classify.class_percent(classify.class_counts(painted, ["image_id"]), ["image_id"])
    row = percent.first()
    assert (row.n1, row.n4, row.p1) == (2, 1, 0.5)
    quality = classify.quality_min(spark.createDataFrame([("a", 2.0)], "image_id string, score double"))
    assert classify.report(percent, quality, ["image_id"]).first()["Quality Score"] == 1.0


def test_open_close_removes_speckle(spark):
    rows = [(0, x, y, 5 if (x, y) == (4, 4) else 1) for x in range(9) for y in range(9)]
    out = stencils.open_close(spark.createDataFrame(rows, "block int, x int, y int, v int"), "v")
    assert out.count() == 81 and out.where("v <> 1").count() == 0


def test_upsert_and_labels(spark):
    rows = spark.createDataFrame([(1, "spring", 5), (2, "summer", 5), (3, "summer", 0), (4, "summer", None)], "pos int, label_set string, label int")
    assert [r.pos for r in training.usable_labels(rows).collect()] == [1]
    out = training.upsert(rows, spark.createDataFrame([(2, "summer", 3), (9, "summer", 1)], rows.schema), ["pos"])
    assert {r.pos: r.label for r in out.collect()} == {1: 5, 2: 3, 3: 0, 4: None, 9: 1}
    log = spark.createDataFrame([(1, 1, 4), (1, 2, 2)], "pos int, t int, label int")
    assert training.latest(log, ["pos"], "t", "label").first().label == 2


def test_names_and_dates(spark):
    row = spark.createDataFrame([("a.b.TIF", "2016:02:29 01:02:03", None)], "name string, exif string, nitf string")
    day = lambda s: names.day_of_year(F.col("exif"), F.col("nitf"), s)
    assert tuple(row.select(names.is_image(F.col("name")), names.base_name(F.col("name")), day("srgb"), day("pan")).first()) == (True, "a.b", 152, 152)


def test_files_sinks_and_streams(spark, tmp_path):
    for name in ("a.tif", ".b.tif", "c.TIFF", "d.png"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x")
    tasks = images.image_tasks(images.list_files(spark, str(tmp_path / "in")))
    assert sorted(r.image_id for r in tasks.collect()) == ["a.tif", "c.TIFF"]
    done = spark.createDataFrame([("a_classified.tif",)], "name string")
    assert [r.image_id for r in images.pending(tasks, done).collect()] == ["c.TIFF"]

    rows = spark.createDataFrame([("spring", 1), ("summer", 2)], "label_set string, label int")
    sinks.write_training_set(rows, str(tmp_path / "tds"))
    sinks.write_training_set(spark.createDataFrame([("spring", 7)], rows.schema), str(tmp_path / "tds"))
    assert {r.label_set: r.label for r in spark.read.parquet(str(tmp_path / "tds")).collect()} == {"spring": 7, "summer": 2}

    painted = spark.createDataFrame([("a", 0, 1, 1, 3)], "image_id string, block int, x int, y int, cls int")
    sinks.write_classified(painted, str(tmp_path / "classes"))
    stream = drop_folder.watch(spark, str(tmp_path / "classes"), "image_id string, block int, x int, y int, cls int").select("block", "cls")
    drop_folder.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().cls == 3
