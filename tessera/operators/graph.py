"""Connected components of graphs too large for a task: alternating stars (Kiveris et al. 2014), as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.staging import discard, staged


def _towards_least(rows: DataFrame, keys: list[str], which: str) -> DataFrame:
    """(keys, u, v, m): ``rows`` (keys, u, v), with the least of u and its neighbours."""
    least = rows.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    met = rows.join(least, [*keys, "u"])
    return met.withColumn("m", F.least("u", "m")).where(which)


def connected(edges: DataFrame, keys: list[str], max_rounds: int = 40) -> DataFrame:
    """(keys, node, root): for every node of ``edges`` (keys, u, v) the least node that it is connected with, within equal ``keys``.

    Each round hangs a node's larger neighbours, and then its smaller ones, on the least of them; after a few rounds, which grow with the logarithm of the graph, every node hangs
    on its component's least, and a round changes nothing. A node's neighbours are minimised and joined, never gathered. Loops and null ends add nothing.
    """
    mark = lambda rows: tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    rows = staged(edges.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "graph")
    was = mark(rows)
    for _ in range(max_rounds):
        both = rows.unionByName(rows.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both, keys, "v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        met = _towards_least(large, keys, "true")
        small = met.select(*keys, "u", F.col("m").alias("v")).unionByName(met.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")))
        after = staged(small.where("u <> v").distinct(), "graph")
        discard(rows)
        rows, before, was = after, was, mark(after)
        if was == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    hung = rows.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    return hung.unionByName(rows.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct())
