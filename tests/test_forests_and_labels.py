"""Bagged forests against a loop over their trees, labels as a stream against a loop over events, and rasters as runs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import bagging, classify, segments, training
from tessera.streaming import drop_folder, label_log


@pytest.fixture(scope="module")
def forest(spark):
    rng = np.random.default_rng(14)
    rows = [(int(i), int(i % 3) if i % 11 else None, [float(v) for v in rng.normal(i % 3, 1.1, 4)]) for i in range(160)]
    frame = spark.createDataFrame(rows, "pos long, label int, features array<double>").repartition(3).cache()
    return frame, rows, bagging.fit_bagged(frame, "pos", "features", trees=5, depth=4, seed=3)


def test_out_of_bag_is_a_loop_over_trees(spark, forest):
    frame, rows, bagged = forest
    weights = {r.pos: list(r)[1:] for r in frame.select("pos", *(bagging.bag_weight(F.col("pos"), k, 3) for k in range(5))).collect()}
    right = judged = 0
    expected = {}
    for pos, label, features in rows:
        if label is None:
            continue
        shares = [t.predictProbability(Vectors.dense(features)).toArray() for k, t in enumerate(bagged.trees) if weights[pos][k] == 0]
        if shares:
            total = np.sum(shares, axis=0)
            expected[pos] = (len(shares), int(total.argmax()))
            judged, right = judged + 1, right + (int(total.argmax()) == label)
    out = bagged.out_of_bag(frame.where("label is not null")).collect()
    assert {r.pos: (r.votes, r.cls) for r in out} == expected
    score = bagging.oob_score(bagged, frame).first()
    assert (score.n, score.judged, score.right) == (sum(label is not None for _, label, _ in rows), judged, right) and score.score == pytest.approx(right / judged)
    assert 0.5 < score.score < 1


def test_weights_are_poisson_and_stay(spark):
    drawn = spark.range(20_000).select(bagging.bag_weight(F.col("id"), 1, 5).alias("a"), bagging.bag_weight(F.col("id"), 2, 5).alias("b"))
    stats = drawn.agg(F.avg("a").alias("mean"), F.var_pop("a").alias("var"), F.avg((F.col("a") == 0).cast("int")).alias("none"), F.corr("a", "b").alias("corr")).first()
    assert abs(stats.mean - 1) < 0.03 and abs(stats["var"] - 1) < 0.05 and abs(stats.none - np.exp(-1)) < 0.015 and abs(stats["corr"]) < 0.03
    assert drawn.repartition(5).agg(F.sum("a")).first()[0] == drawn.agg(F.sum("a")).first()[0]


def test_prediction_and_empty_tables(forest):
    frame, _, bagged = forest
    out = bagged.predict(frame)
    assert out.count() == 160 and out.where("cls = label").count() > 110 and out.where("confidence > 1.0001 or confidence < 0.3").count() == 0
    none = bagging.oob_score(bagged, frame.where("pos < 0")).first()
    assert (none.n, none.judged, none.score) == (0, 0, None)


def test_forests_send_no_rows_to_the_driver(spark):
    features = spark.range(40).select(F.col("id").alias("pos"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"))
    labels = spark.range(5, 50).select(F.col("id").alias("pos"), (F.col("id") % 2).cast("int").alias("label"))
    labelled = training.zip_labels(features, labels)
    score = bagging.oob_score(bagging.fit_bagged(labelled, "pos", "features", trees=2, depth=2), labelled)
    for frame in (labelled, score):
        assert frame.count() and "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert labelled.count() == score.first().n == 35


def _replay(events, every=10):
    labels, trained, last, out = defaultdict(list), defaultdict(int), defaultdict(lambda: -1), []
    for name, seq, action, pos, label in sorted(events, key=lambda e: e[1]):
        if seq <= last[name]:
            continue
        own, last[name], at, value = labels[name], seq, None, None
        if action == "append":
            at, value = len(own), label
            own.append(label)
        elif action == "upsert" and pos is not None and pos >= 0:
            own.extend([None] * (pos + 1 - len(own)))
            own[pos], at, value = label, pos, label
        elif action == "undo":
            there = [i for i, x in enumerate(own) if x is not None]
            if there:
                at = there[-1]
                own[at] = None
        elif action == "trim":
            while own and own[-1] is None:
                own.pop()
        count = sum(x is not None for x in own)
        due = count - trained[name] >= every
        trained[name] = count if due else min(trained[name], count)
        out.append((name, seq, len(own), count, due, at, value))
    return out, {(name, i, x) for name, own in labels.items() for i, x in enumerate(own) if x is not None}


def test_a_label_stream_is_its_replay_also_after_a_restart(spark, tmp_path):
    rng = random.Random(7)
    actions = ["append"] * 6 + ["undo", "upsert", "trim", "other"]
    events = [(rng.choice(["spring", "summer"]), i, rng.choice(actions), rng.choice([None, 0, 3, 12, -1]), rng.choice([None, 1, 2, 3, 4])) for i in range(150)]
    halves = events[:70], events[60:]  # some of the first come again
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k, half in enumerate(halves):
        spark.createDataFrame(half, label_log.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = label_log.label_states(drop_folder.watch(spark, str(tmp_path / "in"), label_log.EVENTS))
        query = drop_folder.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        assert query.awaitTermination(120) and query.exception() is None
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    states = spark.read.schema(label_log.OUTPUT).parquet(str(tmp_path / "out"))
    expected, labels = _replay(events)
    assert sorted(map(tuple, states.collect()), key=lambda r: r[1]) == expected
    assert {tuple(r) for r in label_log.labels_now(states).collect()} == labels
    assert any(r[4] for r in expected)


def test_runs_are_pixels(spark):
    rng = np.random.default_rng(15)
    rows = [(b, x, y, int(rng.integers(0, 2)), *[None if rng.random() < 0.1 else int(rng.integers(0, 2)) for _ in range(2)]) for b in (0, 1) for x in range(12) for y in range(15) if rng.random() < 0.9]
    pixels = spark.createDataFrame(rows, "block int, x int, y int, seg int, b0 int, b1 int")
    found = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 5)], "block int, seg int, cls int")
    runs = classify.paint_runs(segments.runs(pixels, ["b0", "b1"]), found)
    by_pixel = classify.paint(pixels, found, ["b0", "b1"])
    assert sorted(map(tuple, classify.run_pixels(runs).collect())) == sorted(map(tuple, by_pixel.collect()))
    assert runs.count() < len(rows)
    assert sorted(map(tuple, classify.run_counts(runs, ["block"]).collect())) == sorted(map(tuple, classify.class_counts(by_pixel, ["block"]).collect()))
