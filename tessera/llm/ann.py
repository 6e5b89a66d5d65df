"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing, then exact distances."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.prefix import spread_width
from tessera.llm.shared import staged


@dataclass(frozen=True)
class Index:
    """``tables`` of ``hashes`` p-stable hashes of cell width ``width`` (vectors are scaled into the unit ball); a query visits
    ``probes`` buckets of each table. ``part_rows``: index rows that a task takes together, about."""

    tables: int = 12
    hashes: int = 8
    width: float = 2.0
    probes: int = 96
    part_rows: int = 4096
    seed: int = 3

    def functions(self, table: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Directions and offsets of a table's hashes, and odd numbers that combine their cells to one key."""
        rng = np.random.default_rng((self.seed, table))
        return rng.standard_normal((dims, self.hashes)), rng.uniform(0, 1, self.hashes), rng.integers(1, 2**62, self.hashes) * 2 + 1

    def perturbations(self) -> list[tuple[int, ...]]:
        """Sets of ranks to perturb, in order of estimated success (Lv et al. 2007).

        A query's 2 * hashes distances to the edges of its cells are ranked; a set names the edges to cross. The expected
        square of the j-th smallest distance decides on the order, so it is the same for all queries.
        """
        m = self.hashes
        j = np.arange(1, 2 * m + 1)
        low = j * (j + 1) / (4 * (m + 1) * (m + 2))
        back = 2 * m + 1 - j
        cost = np.where(j <= m, low, 1 - back / (m + 1) + back * (back + 1) / (4 * (m + 1) * (m + 2))).tolist()
        heap, found = [(cost[0], (0,))], [()]
        while heap and len(found) < self.probes:
            total, chosen = heapq.heappop(heap)
            if len({min(r, 2 * m - 1 - r) for r in chosen}) == len(chosen):  # not both edges of one cell
                found.append(chosen)
            if (last := chosen[-1]) + 1 < 2 * m:
                heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
                heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        return found

    def keys(self, table: int, points: np.ndarray, probe: bool) -> np.ndarray:
        """Keys of the points' buckets in a table: a column, or one for each bucket to visit, the own first."""
        directions, offset, odd = self.functions(table, points.shape[1])
        place = points @ directions / self.width + offset
        cell = np.floor(place)
        own = (cell.astype(np.int64) * odd).sum(axis=1)
        if not probe:
            return own[:, None]
        part = place - cell
        edge = np.argsort(np.concatenate([part, 1 - part], axis=1) ** 2, axis=1)
        move = np.concatenate([-odd, odd])[edge]
        return np.stack([own + move[:, list(s)].sum(axis=1) for s in self.perturbations()], axis=1)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def _in_ball(x: np.ndarray, largest: float) -> np.ndarray:
    """Points of the unit sphere, one dimension up, whose order by distance from a unit query is that of inner products."""
    scaled = x / largest
    return np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))])


def _unit(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])


def _best(scores: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and scores among vectors with these scores (-inf: not visited); ties to smaller ids."""
    visited = np.flatnonzero(scores > -np.inf)
    if len(visited) > k:
        least = np.partition(scores[visited], len(visited) - k)[len(visited) - k]
        visited = visited[scores[visited] >= least]
    of = np.concatenate([ids[v] for v in visited]) if len(visited) else np.zeros(0, np.int64)
    score = np.repeat(scores[visited], [len(ids[v]) for v in visited])
    order = np.lexsort((of, -score))[:k]
    return of[order], score[order]


def _best_rows(scores: np.ndarray, ids: list[np.ndarray], first: np.ndarray, single: bool, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``_best`` of every row of ``scores``, together where no tie crosses the k-th place and no vector has several ids."""
    if not single or scores.shape[1] <= k:
        return [_best(row, ids, k) for row in scores]
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(scores, top, axis=1)
    least = value.min(axis=1)
    tied = (least > -np.inf) & ((scores >= least[:, None]).sum(axis=1) > k)
    found = first[top]
    return [_best(scores[i], ids, k) if tied[i] else (found[i][keep := value[i] > -np.inf], value[i][keep]) for i in range(len(scores))]


def _search(rows: pd.DataFrame, queries: pd.DataFrame, k: int, index: Index | None, chunk: int = 256) -> pd.DataFrame:
    """(rep, ids, scores): the k best of ``rows`` for each query, among its probed buckets, or all if ``index`` is None."""
    reps, best = [], []
    if len(rows) and len(queries):
        x, ids = _matrix(rows["vector"]), [np.asarray(i, dtype=np.int64) for i in rows["ids"]]
        first, single = np.array([i[0] for i in ids]), all(len(i) == 1 for i in ids)
        if index:
            keys, bucket = np.unique(rows["key"].to_numpy(np.int64), return_inverse=True)
            members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket))[:-1])
        for at in range(0, len(queries), chunk):
            part = queries.iloc[at : at + chunk]
            q = _matrix(part["vector"])
            if index:
                visits = index.keys(int(rows["tab"].iloc[0]), _unit(q), probe=True)
                place = np.minimum(np.searchsorted(keys, visits), len(keys) - 1)
                scores = np.full((len(q), len(x)), -np.inf)
                who, which = np.nonzero(keys[place] == visits)
                at_bucket = place[who, which]
                order = np.argsort(at_bucket, kind="stable")
                who, at_bucket = who[order], at_bucket[order]
                for run in np.split(np.arange(len(who)), np.flatnonzero(np.diff(at_bucket)) + 1):
                    if len(run):
                        mine, found = np.unique(who[run]), members[at_bucket[run[0]]]
                        scores[np.ix_(mine, found)] = q[mine] @ x[found].T
            else:
                scores = q @ x.T
            reps += part["rep"].tolist()
            best += _best_rows(scores, ids, first, single, k)
    hit = [i for i, (found, _) in enumerate(best) if len(found)]
    lists = lambda side: pd.Series([best[i][side] for i in hit], dtype=object)  # noqa: E731  of that type without any, too
    return pd.DataFrame({"rep": np.array([reps[i] for i in hit], np.int64), "ids": lists(0), "scores": lists(1)})


def _merge(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """(rep, vec_id, score): the k best of what was found for each query, an id once."""
    counts = [len(i) for i in group["ids"]]
    rep, ids, score = np.repeat(group["rep"].to_numpy(), counts), np.concatenate(group["ids"].to_list()), np.concatenate(group["scores"].to_list())
    order = np.lexsort((-score, ids, rep))
    rep, ids, score = rep[order], ids[order], score[order]
    once = np.concatenate([[True], (rep[1:] != rep[:-1]) | (ids[1:] != ids[:-1])])
    rep, ids, score = rep[once], ids[once], score[once]
    order = np.lexsort((ids, -score, rep))
    rep, ids, score = rep[order], ids[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]]))
    place = np.arange(len(rep)) - np.repeat(start, np.diff([*start, len(rep)]))
    return pd.DataFrame({"rep": rep, "vec_id": ids, "score": score})[place < k]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", *, index: Index = Index()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows of largest inner product found, the query's own left out.

    ``is_query``, over the columns of ``vectors``, says which rows are queries; all rows are indexed. Equal vectors are
    one point with the k + 1 smallest of their ids, which no result can go beyond. Points go, with each table's
    key, to a part of that table's buckets, and queries to the parts that hold buckets which they probe; the points and queries of a
    part are dealt to shares of a bounded size, and every two shares meet in a task. Every visited point's exact inner
    product is taken, in double precision; a task passes on its k + 1 best for a query, and these are merged.
    A query with fewer than k found is compared with all points, in blocks.

    Null ids, and vectors that are null, zero or hold null or non-finite components, take no part. Vectors of different lengths are never
    compared: each length is searched by itself, one after the other. Repeated rows count once. Other columns are not read but by
    ``is_query``. Ties go to the smaller id. Without candidates a query has no row; an empty input gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & _usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query")
    )
    square = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    lengths = rows.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("largest")).orderBy("dims").collect()
    found = [_nearest_of_length(rows.where(F.size("vector") == r["dims"]), r["n"], r["largest"], k, index) for r in lengths]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _nearest_of_length(rows: DataFrame, count: int, largest: float, k: int, index: Index) -> DataFrame:
    """``nearest`` among ``rows`` (vec_id, vector, query) of one length: ``count`` of them, the longest vector's norm being ``largest``."""
    spark = rows.sparkSession
    rows = staged(rows, "ann-rows")
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    points = rows.select("vector", "vec_id").distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    points = staged(points.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "ann-points")
    asked = staged(rows.where("query").groupBy("vector").agg(F.min("vec_id").alias("rep")), "ann-asked")
    parts = max(1, -(-count // index.part_rows))

    def spread(kind: str):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch["vector"])
                at = _in_ball(x, largest) if kind == "points" else _unit(x)
                for table in range(index.tables):
                    keys = index.keys(table, at, probe=kind == "asked")
                    place = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
                    if kind == "points":
                        yield batch.assign(tab=table, part=place[:, 0].astype(np.int64), key=keys[:, 0])
                    else:
                        place = np.sort(place, axis=1)
                        row, col = np.nonzero(np.column_stack([np.ones(len(place), bool), place[:, 1:] != place[:, :-1]]))
                        yield batch.iloc[row].assign(tab=table, part=place[row, col].astype(np.int64))

        return of

    placed = points.mapInPandas(spread("points"), "vector array<double>, ids array<long>, tab int, part long, key long")
    sent = asked.repartition(spread_width(spark), "rep").mapInPandas(spread("asked"), "vector array<double>, rep long, tab int, part long")
    placed, sent = staged(placed, "ann-placed"), staged(sent, "ann-sent")
    most = F.lit(4.0 * index.part_rows)
    in_tasks = lambda rows, out: rows.groupBy("tab", "part").agg(F.ceil(F.count("*") / most).cast("int").alias(out))
    sizes = in_tasks(placed, "shares").join(in_tasks(sent, "query_shares"), ["tab", "part"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    # a part's points and queries are dealt to shares each, and every two shares meet in a task
    placed = placed.join(sizes, ["tab", "part"]).withColumn("share", deal(F.get("ids", F.lit(0)), "shares")).withColumn("query_share", every("query_shares")).drop("shares", "query_shares")
    sent = sent.join(sizes, ["tab", "part"]).withColumn("query_share", deal("rep", "query_shares")).withColumn("share", every("shares")).drop("shares", "query_shares")
    result = "rep long, ids array<long>, scores array<double>"
    group = ["tab", "part", "share", "query_share"]
    found = placed.groupBy(*group).cogroup(sent.groupBy(*group)).applyInPandas(lambda a, b: _search(a, b, k + 1, index), result)
    bucket = F.pmod(F.xxhash64("rep"), F.lit(max(parts, spread_width(spark))))
    merge = lambda hits: hits.groupBy(bucket).applyInPandas(lambda g: _merge(g, k + 1), "rep long, vec_id long, score double")
    merged = staged(merge(found), "ann-found")
    enough = merged.groupBy("rep").count().where(F.col("count") > k).select("rep")
    short = staged(asked.join(enough, "rep", "left_anti"), "ann-short")
    if not short.isEmpty():
        block = F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(parts)).cast("int")
        runs = max(1, -(-short.count() // (4 * index.part_rows)))
        blocks = points.withColumn("block", block).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
        everywhere = short.withColumn("run", F.pmod(F.xxhash64("rep"), F.lit(runs)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        exact = blocks.groupBy("block", "run").cogroup(everywhere.groupBy("block", "run")).applyInPandas(lambda a, b: _search(a, b, k + 1, None), result)
        merged = merged.join(short.select("rep"), "rep", "left_anti").unionByName(merge(exact))
    queries = rows.where("query").select("vec_id", "vector").distinct().join(asked, "vector").select(F.col("vec_id").alias("query_id"), "rep")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        queries.join(merged.select("rep", "vec_id", "score"), "rep").where("query_id <> vec_id")
        .withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
