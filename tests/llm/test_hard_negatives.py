"""Hard negatives against a loop, with all edges; and the tree's search by itself."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm.hard_negatives import BallTree, Parts, hard_negatives, products, search


def _brute(rows, anchors, k=5, n=3, low=50, high=95):
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    whole = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    out = []
    for i, lab, v in whole:
        if i % anchors:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in whole if len(w) == len(v)]
        positives = sorted((s, j) for s, j, other in scored if other == lab and j != i)[:k]
        for s, p in positives:
            negatives = sorted((t, j) for t, j, other in scored if other != lab and low * -s <= 100 * -t <= high * -s)[:n]
            out += [(i, p, rank, j, -s, -t) for rank, (t, j) in enumerate(negatives, 1)]
    return sorted(out)


@pytest.mark.parametrize("parts", [Parts(), Parts(rows=23, leaf=3, queries=7)])
def test_as_a_loop_finds_them(spark, parts):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in rng.normal(0.2, 0.4, 6)]) for i in range(300)]
    rows += [(1000 + i, 1, rows[7][2]) for i in range(60)]  # a crowd of equal vectors, and ties
    rows += [(2000, None, rows[0][2]), (2005, 1, None), (2010, 1, [0.1, None] + [0.0] * 4), (2015, 2, [float("nan")] * 6), (2020, 2, [float("inf")] * 6), (None, 1, rows[1][2])]
    rows += [(2025, 1, [0.0] * 6), (2030, 1, []), (2035, 2, [1.0, 2.0]), (2036, 2, [1.0, 1.5]), (2037, 3, [1.0, 1.0])] + rows[:9]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, score string").repartition(3)
    out = hard_negatives(frame, F.col("vec_id") % 5 == 0, parts=parts)
    assert sorted(tuple(r) for r in out.collect()) == _brute(rows, 5)


def test_empty_tables_and_none_to_find(spark):
    frame = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    anchors = F.col("vec_id") % 2 == 0
    for few in (frame.where("vec_id < 0"), frame.where("vec_id = 1"), frame):
        assert hard_negatives(few, anchors).collect() == []


def test_nodes_bound_their_points():
    rng = np.random.default_rng(5)
    x, labels = rng.integers(-90, 90, (200, 5)), rng.integers(0, 2, 200)
    tree, q = BallTree(x, labels, 8), rng.integers(-90, 90, (9, 5))
    assert sorted(tree.order.tolist()) == list(range(200))
    for low, high, centre, radius in zip(tree.low, tree.high, tree.centre, tree.radius):
        dots, middle = q @ x[tree.order[low:high]].T, q @ centre
        reach = np.sqrt((q**2).sum(axis=1)) * radius + 1e-6
        assert (dots <= (middle + reach)[:, None]).all() and (dots >= (middle - reach)[:, None]).all()


def test_search_prunes_and_keeps_ties():
    x = np.repeat(np.arange(50), 4)[:, None] * np.ones((1, 3), int)
    frame = pd.DataFrame({"vector": list(x), "vec_id": np.arange(200)[::-1], "row": np.arange(200), "label": 0})
    looked = []

    def allowed(who, at):
        looked.append(len(at))
        return np.ones((len(who), len(at)), bool)

    score, place = search(frame, np.array([[1, 1, 1]]), allowed, np.array([0]), np.array([90]), 3, 4)
    assert score.tolist() == [[90, 90, 90]] and frame["vec_id"][place[0]].tolist() == [76, 77, 78]
    assert sum(looked) < 60  # of 200


def test_products_are_exact_or_refused():
    big = np.array([[2**27, 1]])
    assert products(big, big)[0, 0] == 2**54 + 1
    with pytest.raises(ValueError, match="fit"):
        products(np.array([[2**32]]), np.array([[2**32]]))
