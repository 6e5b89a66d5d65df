"""Hard negatives of anchors by inner product: ball trees of bounded parts, searched by branch and bound."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import staged

_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Parts:
    """``rows`` of the table that one tree holds, about; ``leaf``: rows that are no more split; ``queries`` that a task takes together, about."""

    rows: int = 2048
    leaf: int = 32
    queries: int = 2048


class BallTree:
    """Balls around points of whole numbers: each node's centre and radius bound its points' inner products both above and below.

    A node is cut at the median of its points' places between two far ones. ``order`` has the points of every node together.
    """

    def __init__(self, points: np.ndarray, labels: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.low, self.high, self.left, self.centre, self.radius, self.label = [], [], [], [], [], []
        x, todo = points.astype(np.float64), [self._node(0, len(points))]
        while todo:
            node = todo.pop()
            own = self.order[self.low[node] : self.high[node]]
            centre = x[own].mean(axis=0)
            away = np.sqrt(((x[own] - centre) ** 2).sum(axis=1))
            self.centre[node], self.radius[node] = centre, float(away.max())
            self.label[node] = labels[own[0]] if (labels[own] == labels[own[0]]).all() else None
            if len(own) > leaf and self.radius[node] > 0:
                one = x[own[away.argmax()]]
                two = x[own[((x[own] - one) ** 2).sum(axis=1).argmax()]]
                cut = len(own) // 2
                self.order[self.low[node] : self.high[node]] = own[np.argpartition(x[own] @ (two - one), cut)]
                middle = self.low[node] + cut
                self.left[node] = self._node(self.low[node], middle)
                todo += [self.left[node], self._node(middle, self.high[node])]

    def _node(self, low: int, high: int) -> int:
        self.low.append(low)
        self.high.append(high)
        for column in (self.left, self.centre, self.radius, self.label):
            column.append(None)
        return len(self.low) - 1


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers (int64): by floats where these are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most >= 2**62:
        raise ValueError("inner products do not fit a long")
    return q @ x.T


def search(points: pd.DataFrame, q: np.ndarray, allowed, low: np.ndarray, high: np.ndarray, k: int, leaf: int, skip_label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places in ``points``), each queries x k: the k best points, ties by (vec_id, row), with a score from ``low`` to ``high``; unused places have the least score.

    ``allowed(queries, places)`` is a mask of what a query may take; ``skip_label``: labels that queries never take, so that nodes of one label can be passed over. A batch of
    queries goes down the tree together; those whose bounds lie outside their window, or strictly beneath their current k-th score, stop at a node.
    """
    x = np.stack(points["vector"].to_list()).astype(np.int64)
    ids, rows = points["vec_id"].to_numpy(np.int64), points["row"].to_numpy(np.int64)
    labels = points["label"].to_numpy(np.int64)
    rank = np.empty(len(points), np.int64)
    rank[np.lexsort((rows, ids))] = np.arange(len(points))
    tree, size = BallTree(x, labels, leaf), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    score, place = np.full((len(q), k), _NONE), np.zeros((len(q), k), np.int64)
    reach = max(float(np.abs(x).max(initial=0)) * np.sqrt(x.shape[1]), 1.0)

    def bounds(node: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle, spread = q[who] @ tree.centre[node], size[who] * (tree.radius[node] + 1e-9 * reach) + 1e-6
        return middle - spread, middle + spread

    def open_to(node: int, who: np.ndarray) -> tuple[np.ndarray, float]:
        if skip_label is not None and tree.label[node] is not None:
            who = who[skip_label[who] != tree.label[node]]
        below, above = bounds(node, who)
        kept = (above >= np.maximum(low[who], score[who, -1])) & (below <= high[who])
        return who[kept], float(above[kept].mean()) if kept.any() else 0.0

    todo = [(0, np.arange(len(q)))]
    while todo:
        node, who = todo.pop()
        who, _ = open_to(node, who)  # again: the k-th may have risen
        if not len(who):
            continue
        if tree.left[node] is not None:
            children = [(c, *open_to(c, who)) for c in (tree.left[node], tree.left[node] + 1)]
            todo += [(c, w) for c, w, _ in sorted(children, key=lambda t: t[2]) if len(w)]  # the more promising one is taken first
            continue
        own = tree.order[tree.low[node] : tree.high[node]]
        found = products(q[who], x[own])
        found[(found < low[who, None]) | (found > high[who, None]) | ~allowed(who, own)] = _NONE
        all_scores, all_places = np.concatenate([score[who], found], axis=1), np.concatenate([place[who], np.broadcast_to(own, found.shape)], axis=1)
        best = np.lexsort((rank[all_places], -np.maximum(all_scores, _NONE + 1)), axis=-1)[:, :k]
        score[who], place[who] = np.take_along_axis(all_scores, best, axis=1), np.take_along_axis(all_places, best, axis=1)
    return score, place


def _whole(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _dealt(points: DataFrame, queries: DataFrame, on: list[str], parts: Parts) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points dealt to parts of a bounded size within ``on``, and queries to blocks; each two meet in a group, so each is sent to as many as there are of the other."""
    count = lambda rows, most, out: rows.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(out))
    sizes = count(points, parts.rows, "parts").join(count(queries, parts.queries, "blocks"), on)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    points = points.toDF(*points.columns)
    placed = points.join(sizes, on).withColumn("part", deal("parts")).withColumn("block", every("blocks")).drop("parts", "blocks")
    again = queries.toDF(*queries.columns)  # columns of their own, where both come of one table
    sent = again.join(sizes, on).withColumn("block", deal("blocks")).withColumn("part", every("parts")).drop("parts", "blocks")
    return placed, sent, [*on, "part", "block"]


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), *,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", label: Column | None = None, parts: Parts = Parts(),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives the best ``negatives`` rows of other labels whose
    score is ``window`` per cent of the positive's.

    A row's score is the inner product of floor(256 * x), taken in each component; higher ones come first, ties by smaller id. An anchor's positives are its first ``positives`` other
    rows of its label. ``is_anchor`` is over the columns of ``vectors``; ``label``, if given, stands for ``label_col``.

    Two searches, each of anchors in blocks against ball trees of bounded parts: positives among parts of the anchor's label, negatives, all windows of an
    anchor at once, among parts of all rows. A task passes on a few rows for an anchor, and these are ranked. Anchors are compared with every part, so the
    work is anchors times rows but for what the bounds spare.

    Null ids, labels and vectors, and vectors that hold null or non-finite components, take no part; zero and empty vectors do. Vectors of different lengths are
    never compared. Repeated rows count once; rows of one id that differ are rows of their own, but never positives of each other. Windows of negative scores are
    empty. Inner products beyond a long are an error. Other columns are not read but by ``is_anchor`` and ``label``; without anchors, or rows, the result is empty.
    """
    own_label = F.col(label_col) if label is None else label
    usable = F.col(id_col).isNotNull() & own_label.isNotNull() & F.col(vector_col).isNotNull() & _finite(F.col(vector_col))
    rows = vectors.where(usable).select(
        F.col(id_col).cast("long").alias("vec_id"), own_label.cast("long").alias("label"), _whole(F.col(vector_col)).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    )
    # numbered where it is written, so that the numbers stay
    rows = staged(rows.distinct().select(F.monotonically_increasing_id().alias("row"), "*", F.size("vector").alias("dims")), "mined-rows")
    points, anchors = rows.select("row", "vec_id", "label", "dims", "vector"), rows.where("anchor").select("row", "vec_id", "label", "dims", "vector")
    leaf = parts.leaf

    def nearest(x: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(a):
            return pd.DataFrame({"row": [], "positive_id": [], "other": [], "score": []}, dtype=np.int64)
        own, ids = a["vec_id"].to_numpy(), x["vec_id"].to_numpy()
        ends = np.full(len(a), _NONE), np.full(len(a), np.iinfo(np.int64).max)
        score, place = search(x, np.stack(a["vector"].to_list()).astype(np.int64), lambda who, at: own[who, None] != ids[None, at], *ends, positives, leaf)
        which, _ = hit = np.nonzero(score > _NONE)
        return pd.DataFrame({"row": a["row"].to_numpy()[which], "positive_id": ids[place[hit]], "other": x["row"].to_numpy()[place[hit]], "score": score[hit]})

    x, a, on = _dealt(points, anchors, ["dims", "label"], parts)
    found = x.groupBy(*on).cogroup(a.groupBy(*on)).applyInPandas(nearest, "row long, positive_id long, other long, score long")
    order = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "positive_id", "other"))
    found = found.withColumn("nth", order).where(F.col("nth") <= positives)
    near = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "score"))).alias("wanted"))  # a few an anchor
    near = staged(near, "mined-positives")
    # whole scores from ceil(low * s / 100) to floor(high * s / 100), by exact division
    share = lambda s, percent: (s * percent - F.pmod(s * percent, F.lit(100))).cast("decimal(38,0)") / 100
    windows = anchors.join(near, "row").select(
        "row", "dims", "label", "vector",
        F.transform("wanted", lambda w: (-share(w["score"], F.lit(-window[0]))).cast("long")).alias("least"),
        F.transform("wanted", lambda w: share(w["score"], F.lit(window[1])).cast("long")).alias("most"),
    )

    def others(x: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(a):
            return pd.DataFrame({"row": [], "nth": [], "negative_id": [], "other": [], "score": []}, dtype=np.int64)
        each = np.array([len(w) for w in a["least"]])
        of = np.repeat(np.arange(len(a)), each)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each) + 1
        least, most = (np.concatenate(a[c].to_list()).astype(np.int64) for c in ("least", "most"))
        q, own, labels = np.stack(a["vector"].to_list()).astype(np.int64)[of], a["label"].to_numpy()[of], x["label"].to_numpy()
        score, place = search(x, q, lambda who, at: own[who, None] != labels[None, at], least, most, negatives, leaf, skip_label=own)
        which, _ = hit = np.nonzero(score > _NONE)
        at = place[hit]
        return pd.DataFrame({"row": a["row"].to_numpy()[of[which]], "nth": nth[which], "negative_id": x["vec_id"].to_numpy()[at], "other": x["row"].to_numpy()[at], "score": score[hit]})

    x, a, on = _dealt(points, windows, ["dims"], parts)
    met = x.groupBy(*on).cogroup(a.groupBy(*on)).applyInPandas(others, "row long, nth long, negative_id long, other long, score long")
    rank = F.row_number().over(Window.partitionBy("row", "nth").orderBy(F.desc("score"), "negative_id", "other"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = near.select("row", F.explode("wanted").alias("w")).select("row", F.col("w.nth").alias("nth"), F.col("w.positive_id").alias("positive_id"), F.col("w.score").alias("positive_score"))
    return (
        best.join(named, ["row", "nth"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
    )


_WHOLE_SQL = "[cast(floor(256 * cast(x as double)) as double) for x in embedding]"
#: For DuckDB: every anchor against every row.
OP11_SQL = f"""with e as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_WHOLE_SQL} as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, e.vec_id as other, e.label as label, cast(list_inner_product(a.v, e.v) as bigint) as score
  from e a join e on a.vec_id <> e.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from s where own = label qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) as integer) as rank, s.other as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and s.own <> s.label and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) <= 3"""
