"""Kernels over scenes: the same for blocks of any size as for the whole scene at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.model import SENSORS
from tessera.operators import graph, kernels, scene

ROWS, COLS = 150, 97


@pytest.fixture(scope="module")
def image(spark):
    rng = np.random.default_rng(6)
    patch = np.kron(rng.integers(20, 230, (10, 7)), np.ones((15, 14), int))[:ROWS, :COLS]
    bands = [np.clip(patch[:, :COLS] + rng.integers(-9, 10, (ROWS, patch.shape[1])), 1, 255) for _ in range(3)]
    rows = [(7, x, y, *(int(b[x, y]) for b in bands)) for x in range(ROWS) for y in range(bands[0].shape[1])]
    frame = spark.createDataFrame(rows, "id int, x int, y int, b0 int, b1 int, b2 int").repartition(5).cache()
    return frame, [b.astype(float) for b in bands]


def _array(frame, column, shape):
    out = np.full(shape, np.nan)
    for r in frame.select("x", "y", column).collect():
        assert np.isnan(out[r.x, r.y])
        out[r.x, r.y] = r[column]
    return out


@pytest.mark.parametrize("size", [32, 64, 128, 1000])
def test_local_kernels_know_no_borders(image, size):
    frame, bands = image
    shape, s = bands[0].shape, SENSORS["srgb"]
    assert (_array(scene.gradient_scene(frame, ["id"], "b2", s.sigma, size=size), "gradient", shape) == kernels.gradient(bands[2], s.sigma)).all()
    assert (_array(scene.maxima_scene(frame, ["id"], "b1", 3, size=size), "maximum", shape) == kernels.maxima(bands[1], 3)).all()
    assert (_array(scene.edges_scene(frame, ["id"], "b1", s.sigma, s.low, s.high, size=size), "edge", shape) == kernels.edges(bands[1], s.sigma, s.low, s.high)).all()


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("size", [16, 50])
def test_components_go_on_across_borders(spark, diagonal, size):
    rng = np.random.default_rng(8)
    masks = [rng.random((60, 70)) < 0.55, np.ones((60, 70), bool), np.zeros((60, 70), bool)]
    rows = [(i, x, y, int(m[x, y])) for i, m in enumerate(masks) for x in range(60) for y in range(70)]
    out = scene.components_scene(spark.createDataFrame(rows, "id int, x int, y int, m int"), ["id"], "m", diagonal=diagonal, size=size)
    for i, m in enumerate(masks):
        numbers = kernels.components(m, diagonal)
        firsts = {n: int(np.flatnonzero(numbers.ravel() == n)[0]) for n in np.unique(numbers[numbers > 0])}
        expected = np.vectorize(lambda n: firsts.get(n, -1))(numbers)
        assert (_array(out.where(F.col("id") == i), "component", m.shape) == expected).all()


@pytest.mark.parametrize("gaps", [False, True])
def test_distances_over_scenes(spark, gaps):
    rng = np.random.default_rng(9)
    masks = {0: rng.random((40, 31)) < 0.02, 1: np.zeros((5, 9), bool), 2: rng.random((3, 50)) < 0.1}
    there = {i: rng.random(m.shape) < 0.7 if gaps else np.ones(m.shape, bool) for i, m in masks.items()}
    for t in there.values():
        t[-1, -1] = True
    rows = [(i, x, y, int(m[x, y])) for i, m in masks.items() for x in range(m.shape[0]) for y in range(m.shape[1]) if there[i][x, y]]
    out = scene.distance_scene(spark.createDataFrame(rows, "id int, x int, y int, m int"), ["id"], "m", most=100)
    for i, m in masks.items():
        at = np.argwhere(m & there[i])
        expected = np.array([[np.sqrt(((at - (r, c)) ** 2).sum(axis=1).min()) if len(at) else np.inf for c in range(m.shape[1])] for r in range(m.shape[0])])
        found = _array(out.where(F.col("id") == i), "distance", m.shape)
        assert (np.isnan(found) == ~there[i]).all() and np.allclose(found[there[i]], expected[there[i]])


def test_segments_over_a_scene(image):
    frame, bands = image
    whole = kernels.segment(bands, SENSORS["srgb"])
    one = _array(scene.segments_scene(frame, ["id"], ["b0", "b1", "b2"], size=1000), "seg", whole.shape)
    pairs = {(a, b) for a, b in zip(whole.ravel().tolist(), one.ravel().tolist())}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})  # the same segments under other names
    cut = _array(scene.segments_scene(frame, ["id"], ["b0", "b1", "b2"], size=64, halo=40), "seg", whole.shape)
    assert (cut == one).mean() > 0.97
    assert (cut[63] == cut[64]).mean() > 0.8  # segments have one name on both sides of a block's border


def test_scenes_without_data_and_null_bands(spark):
    rows = [(1, x, y, 0, 0, None) for x in range(9) for y in range(9)]
    frame = spark.createDataFrame(rows, "id int, x int, y int, b0 int, b1 int, b2 int")
    assert {r.seg for r in scene.segments_scene(frame, ["id"], ["b0", "b1", "b2"], size=4, halo=2).collect()} == {-1}
    assert scene.components_scene(frame.where("x < 0"), ["id"], "b0").count() == 0
    assert scene.distance_scene(frame.where("x < 0"), ["id"], "b0").count() == 0
    with pytest.raises(Exception, match="tile the scene finer"):
        scene.gradient_scene(spark.createDataFrame([(1, 5000, 5000, 1)], "id int, x int, y int, b0 int"), ["id"], "b0", 1.0, size=8192).collect()


def test_graphs(spark):
    rng = np.random.default_rng(10)
    edges = [(k, int(a), int(b)) for k in (1, 2) for a, b in rng.integers(0, 400, (330, 2))] + [(3, i, i + 1) for i in range(300)] + [(4, 0, i) for i in range(1, 300)] + [(5, 1, 1), (5, None, 2)]
    out = {(r.k, r.node): r.root for r in graph.connected(spark.createDataFrame(edges, "k int, u long, v long"), ["k"]).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find((k, a)), find((k, b))))
            parent[b] = a
    assert out == {n: find(n)[1] for n in parent}
    assert graph.connected(spark.createDataFrame([], "k int, u long, v long"), ["k"]).count() == 0
