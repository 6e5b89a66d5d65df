"""A batch run on made-up scenes, against the kernels and rules one by one; and what stands around it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.model import SENSORS
from tessera.operators import classify, kernels, ordered, radiometry, run, segments, tiling, training
from tessera.sources import images, sinks


def _thinned(peaks):
    """Peaks (value, count) with the lower of near neighbours gone, by loops: reach 5, 10, ... up to a sixth of their span."""
    for reach in range(5, max(5, (peaks[-1][0] - peaks[0][0]) // 6) + 1 if peaks else 0, 5):
        gone, at = set(), 0
        while at < len(peaks) - 1:
            (here, n), (there, m) = peaks[at], peaks[at + 1]
            near = there - here < reach
            if near:
                gone.add(at if n < m else at + 1)
            at += 2 if near and n >= m else 1
        peaks = [p for k, p in enumerate(peaks) if k not in gone]
    return [p[0] for p in peaks]


def test_peaks_are_thinned_as_by_loops(spark):
    rng = np.random.default_rng(20)
    cases = [[(10, 5)], [(10, 5), (12, 9), (90, 4)], [(10, 5), (12, 5), (14, 5)], [(10, 9), (12, 5), (40, 5)]]
    cases += [[(int(d), int(rng.integers(1, 30))) for d in sorted(rng.choice(2000, n, replace=False))] for n in (2, 3, 20, 100, 300) for _ in range(6)]
    rows = [(k, dn, h) for k, peaks in enumerate(cases) for dn, h in peaks]
    out = radiometry.peaks(spark.createDataFrame(rows, "k int, dn long, h long").repartition(3), ["k"]).collect()
    assert [sorted(r.peak for r in out if r.k == k) for k in range(len(cases))] == [_thinned(c) for c in cases]


def _peaks(h, dn):
    """Candidate peaks of a histogram, and what is left of them, by loops."""
    least, n, found = int(sum(h) * 0.004), len(h), []
    for i in range(n):
        low, high = (i if i < 5 else 5), (n - 1 - i if i > n - 6 else 5)
        if i == 0:
            ok = h[0] >= h[1] and h[0] >= h[5] and h[-1] > least
        elif i == n - 1:
            ok = h[i] >= h[i - 1] and h[i] >= h[i - 5] and h[i] > least
        else:
            ok = h[i] >= h[i - 1] and h[i] >= h[i + 1] and h[i] >= h[i - low] and h[i] >= h[i + high] and h[i] > least
        if ok:
            found.append((dn[i], h[i]))
    return _thinned(found)


def _cuts(values):
    first, last = int(values.min()), int(values.max())
    dn = list(range(first, last))
    h = [int((values == v).sum()) for v in dn]
    peaks = _peaks(h, dn)
    up = at = dn.index(max(peaks))
    while at < len(dn) - 1 and h[at] > 0.15 * h[up]:
        at = min(at + 2, len(dn) - 1)
    white = dn[at]
    low = at = dn.index(min(peaks))
    while at > 0 and h[at] > 0.5 * h[low]:
        at -= 1
    black = dn[at]
    wide = (min(peaks) - black) / 255 >= 0.03 or max(peaks) - min(peaks) < 255 / 3
    return (min(black, int(0.08 * 255)) if wide else black), white, black, len(peaks)


@pytest.fixture(scope="module")
def scenes(spark):
    rng = np.random.default_rng(21)
    rows, arrays = [], {}
    for k in range(3):
        patch = np.kron(rng.integers(20, 230, (5, 4)), np.ones((9, 10), int))
        bands = [np.clip(patch + rng.integers(-12, 13, patch.shape) + 6 * b, 1, 255) for b in range(3)]
        bands[0][:4, :6] = bands[1][:4, :6] = bands[2][:4, :6] = 0
        arrays[f"scene{k}"] = bands
        rows += [(f"scene{k}", x, y, *(int(b[x, y]) for b in bands)) for x in range(45) for y in range(40)]
    return spark.createDataFrame(rows, "image_id string, x int, y int, b0 int, b1 int, b2 int").repartition(3).cache(), arrays


def test_stretch_from_histograms_by_loops(spark, scenes):
    pixels, arrays = scenes
    out = {r.image_id: r for r in run.stretch_params(pixels, run.Options()).collect()}
    for name, bands in arrays.items():
        cuts = [_cuts(b.ravel()) for b in bands]
        upper = max(c[1] for c in cuts)
        if sum(c[3] for c in cuts) <= 3:
            upper = max(upper, 204)
        assert (out[name].lower, out[name].upper) == (min(c[0] for c in cuts), upper)
        assert list(out[name].white) == [c[1] for c in cuts] and list(out[name].black) == [c[2] for c in cuts]


def test_a_run_is_its_steps(spark, scenes):
    pixels, arrays = scenes
    days = spark.createDataFrame([("scene0", 100), ("scene1", 200), ("scene2", None)], "image_id string, day int")
    rng = np.random.default_rng(22)
    rows = spark.createDataFrame(
        [(s, i, int(i % 5) + 1, [float(v) for v in rng.normal(40.0 * (i % 5), 5, 16)]) for s in ("spring", "srgb") for i in range(60)], "label_set string, pos long, label int, features array<double>"
    )
    options = run.Options(block=32, trees=10, depth=5)
    out = run.classify_scenes(pixels, days, rows, options)
    painted, report = out.painted.toPandas(), {r.image_id: r for r in out.report.collect()}
    assert len(painted) == 3 * 45 * 40 and len(painted.drop_duplicates(["image_id", "x", "y"])) == len(painted)
    params = {r.image_id: r for r in run.stretch_params(pixels, options).collect()}
    sensor = SENSORS["srgb"]
    for name, bands in arrays.items():
        mine = painted[painted.image_id == name]
        assert set(mine.cls[[(x < 4 and y < 6) for x, y in zip(mine.x, mine.y)]]) == {0}
        assert [(mine.cls == k).sum() for k in range(1, 6)] == [report[name][c] for c in ("White Ice", "Gray Ice", "Melt Ponds", "Open Water", "Shadow")]
        blocks = [(slice(x, min(x + 32, 45)), slice(y, min(y + 32, 40))) for x in (0, 32) for y in (0, 32)]
        assert report[name]["Quality Score"] == pytest.approx(min([1.0, *(kernels.quality_score(bands[0][b].astype(float)) for b in blocks)]))
        p = params[name]
        fixed = [np.where(b == 0, 0, (np.clip(b, p.lower, p.upper) - p.lower) * 254 // (p.upper - p.lower) + 1) for b in bands]
        fixed = [np.where(b == 0, 0, np.clip(np.floor(max(p.white) / w * b), 1, 255)) for b, w in zip(fixed, p.white)]
        for rows_, cols in blocks:
            found = kernels.segment([b[rows_, cols] for b in fixed], sensor)
            own = mine[(mine.x >= rows_.start) & (mine.x < rows_.stop) & (mine.y >= cols.start) & (mine.y < cols.stop)].sort_values(["x", "y"])
            assert own.seg.tolist() == (found - found.min()).ravel().tolist()
    one = painted[painted.cls > 0].groupby(["block", "seg"]).cls.nunique()
    assert (one == 1).all()


def _training(spark, n=16, sets=("spring", "summer")):
    return spark.createDataFrame([(s, i, i % 5 + 1, [float(i % 5 * 40)] * n) for s in sets for i in range(50)], "label_set string, pos long, label int, features array<double>")


@pytest.mark.parametrize("value", [lambda x, y: 77, lambda x, y: 77 + 22 * (y % 2), lambda x, y: 0, lambda x, y: 255])
def test_scenes_of_one_value_or_two(spark, value):
    pixels = spark.createDataFrame([("flat", x, y, *[value(x, y)] * 3) for x in range(30) for y in range(30)], "image_id string, x int, y int, b0 int, b1 int, b2 int")
    days = spark.createDataFrame([("flat", 100)], "image_id string, day int")
    params = run.stretch_params(pixels, run.Options()).first()
    assert (params.lower, params.upper, list(params.white)) == (1, 255, [255.0] * 3)
    out = run.classify_scenes(pixels, days, _training(spark), run.Options(block=16, trees=5, depth=4))
    report = out.report.first()
    counts = [report[c] for c in ("White Ice", "Gray Ice", "Melt Ponds", "Open Water", "Shadow")]
    assert out.painted.where("cls is null").count() == 0 and sum(counts) == (900 if value(0, 0) else 0)
    fixed = radiometry.corrected(pixels, run.stretch_params(pixels, run.Options()), ["image_id"], ["b0", "b1", "b2"], True)
    assert fixed.where("b0 is null or b1 is null or b2 is null").count() == 0


def test_a_label_set_without_rows_is_named(spark, scenes):
    pixels, _ = scenes
    days = spark.createDataFrame([("scene0", 100), ("scene1", 200)], "image_id string, day int")
    with pytest.raises(ValueError, match="summer"):
        run.classify_scenes(pixels, days, _training(spark, sets=("spring",)), run.Options(block=32, trees=5, depth=3))


def test_null_bands_have_no_data(spark):
    pixels = spark.createDataFrame([(0, 0, 0, 1, 0, None, 0), (0, 0, 1, 1, 0, 5, 0), (0, 0, 2, 1, None, None, None)], "block int, x int, y int, seg int, b0 int, b1 int, b2 int")
    found = spark.createDataFrame([(0, 1, 3)], "block int, seg int, cls int")
    assert sorted((r.y, r.cls) for r in classify.paint(pixels, found, ["b0", "b1", "b2"]).collect()) == [(0, 0), (1, 3), (2, 0)]


def test_a_run_with_segments_across_blocks(spark, scenes):
    pixels, _ = scenes
    days = pixels.select("image_id").distinct().withColumn("day", F.lit(100))
    out = run.classify_scenes(pixels, days, _training(spark), run.Options(block=16, halo=16, trees=5, depth=4, stretch="pansh"))
    painted = out.painted.toPandas()
    assert len(painted) == 3 * 45 * 40 and (painted.block == painted.image_id).all()
    both = painted[painted.x == 15].merge(painted[painted.x == 16], on=["image_id", "y"])
    assert (both.seg_x == both.seg_y).mean() > 0.5
    assert (painted[painted.cls > 0].groupby(["image_id", "seg"]).cls.nunique() == 1).all()


def test_other_sensors_run(spark, scenes):
    pixels, _ = scenes
    days = pixels.select("image_id").distinct().withColumn("day", F.lit(170))
    wide = pixels.withColumns({f"b{k}": F.col(f"b{k % 3}") * 4 for k in range(8)})
    for sensor, frame, n in (("pan", pixels.drop("b1", "b2"), 12), ("wv02_ms", wide, 31)):
        rows = spark.createDataFrame([(sensor, i, i % 4 + 1, [float(i % 4 * 30)] * n) for i in range(40)], "label_set string, pos long, label int, features array<double>")
        out = run.classify_scenes(frame, days, rows, run.Options(sensor=sensor, stretch="none", src_dtype=16, block=48, trees=5, depth=4))
        assert out.painted.count() == 3 * 45 * 40 and {r["Quality Score"] for r in out.report.collect()} == {1.0}


def test_kernel_neighbours_with_gaps(spark, scenes):
    pixels, _ = scenes
    frame = pixels.where("image_id = 'scene0' and not (x % 7 = 3 and y % 5 = 1)").withColumns({"block": F.lit(0), "seg": (F.floor(F.col("x") / 9) * 4 + F.floor(F.col("y") / 10)).cast("int")})
    low = frame.where("x < 41")  # a block whose last rows have no pixels, but count
    joined = segments.value_counts(segments.neighbours(low, 45, 40, "literal", ("b1",)), "b1")
    counted = kernels.neighbour_counts(low.withColumn("h", F.lit(45)), height="h")
    assert sorted((r.seg, r.v, r.c) for r in counted.collect()) == sorted((r.seg, r.v, r.c) for r in joined.collect())
    for mode in ("literal", "clean", "training"):
        joined = segments.value_counts(segments.neighbours(frame, 45, 40, mode, ("b1",)), "b1")
        expected = sorted((r.seg, r.v, r.c) for r in joined.collect())
        assert sorted((r.seg, r.v, r.c) for r in kernels.neighbour_counts(frame, mode).collect()) == expected
    assert kernels.neighbour_counts(frame.where("x < 0")).count() == 0


def test_a_block_too_large_is_refused(spark):
    frame = spark.createDataFrame([(0, 0, 0, 1), (0, 5000, 5000, 1)], "block int, x int, y int, b0 int")
    with pytest.raises(Exception, match="tile the scene finer"):
        kernels.block_quality(frame).collect()


def test_orders_over_all_rows(spark):
    rng = np.random.default_rng(23)
    values = [int(v) for v in rng.permutation(5000)[:700]]
    frame = spark.createDataFrame([(v, v % 91) for v in values], "k int, v int").repartition(5)
    at = sorted(values)
    out = {r.k: r.m for r in ordered.running(frame, "k", F.min, "v", "m").collect()}
    assert out == {k: min(x % 91 for x in at[: i + 1]) for i, k in enumerate(at)}
    assert {r.k: r.n for r in ordered.numbered(frame, "k", "n").collect()} == {k: i for i, k in enumerate(at)}
    assert {r.k: r.n for r in ordered.with_next(frame, "k", "n").collect()} == dict(zip(at, [*at[1:], at[0]]))
    few = frame.where("k < 0")
    assert ordered.numbered(few, "k", "n").count() == 0 and ordered.with_next(few, "k", "n").count() == 0
    assert [(r.k, r.n) for r in ordered.with_next(frame.where(f"k = {at[9]}"), "k", "n").collect()] == [(at[9], at[9])]


def test_training_sets(spark, tmp_path):
    empty = images.open_training_set(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and images.training_file("pan") == "pan_training_data"
    rows = spark.createDataFrame([("spring", i, i % 7, [float(i)]) for i in range(30)], empty.schema)
    sinks.write_training_set(rows, str(tmp_path / "tds"))
    stored = images.open_training_set(spark, str(tmp_path / "tds"))
    assert stored.count() == 30
    with pytest.raises(ValueError, match="features"):
        images.checked_training_set(rows.drop("features"))
    assert {r.label for r in training.training_rows(stored, "spring", "srgb").collect()} == {1, 2, 3, 4, 5}
    assert training.training_rows(stored, "summer", "srgb").count() == 0
    assert training.retrained(stored.limit(9), "features") is None
    assert training.retrained(stored, "features", trees=3, depth=3).getNumTrees == 3
    painted = spark.createDataFrame([("a", 0, 1, 1, 3), ("b", 0, 1, 1, 2)], "image_id string, block int, x int, y int, cls int")
    sinks.write_classified(painted, str(tmp_path / "classes"))
    assert [r.cls for r in images.classified(spark, str(tmp_path / "classes"), ["b"]).collect()] == [2]


def test_reports_and_matches(spark, tmp_path):
    report = spark.createDataFrame([("a", 1.0)], "image_id string, quality double")
    for _ in range(2):
        sinks.append_report(report, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    names = spark.createDataFrame([("im1",), ("none",), ("",)], "image string")
    paths = spark.createDataFrame([(0, "x/im1.tif"), (1, "x/im12.tif"), (2, "x/other.tif")], "place int, path string")
    assert [(r.image, r.path) for r in training.last_match(names, paths).collect()] == [("im1", "x/im12.tif")]
    pixels = spark.createDataFrame([(0, 0, 7)], "x int, y int, b0 int")
    assert tuple(tiling.display(pixels, "pan").first()) == (0, 0, 7, 7, 7) and tiling.band_arrays(pixels, ["b0"]).first().bands == [7]


def test_importances_and_hold_out(spark):
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2).cast("double").alias("good"), F.rand(1).alias("bad"))
    out = classify.importances(rows, ["bad", "good"], trees=10, depth=3).collect()
    assert [r.place for r in out] == [1, 2, 3] and out[0].feature == "good" and out[0].importance > 0.5
    held = classify.hold_out(rows, "id", ["good"], trees=5, depth=3).first()
    assert held.n > 40 and held.accuracy == 1.0


def test_streams_of_counts(spark, tmp_path):
    from tessera.streaming import drop_folder

    rows = [("a", f"2024-01-01 00:0{i}:00", i % 3 + 1) for i in range(6)]
    frame = spark.createDataFrame(rows, "image_id string, t string, cls int").withColumn("t", F.to_timestamp("t"))
    assert tuple(drop_folder.count_classes(frame, ["image_id"]).first()) == ("a", 2, 2, 2, 0, 0)
    frame.write.parquet(str(tmp_path / "in"))
    stream = drop_folder.watch(spark, str(tmp_path / "in"), "image_id string, t timestamp, cls int")
    counts = drop_folder.windowed_counts(stream, "t", "2 minutes", "1 minute", ["image_id"]).select("image_id", F.col("window.start").alias("start"), "n")
    drop_folder.run_available(counts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert {r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} <= {2}
