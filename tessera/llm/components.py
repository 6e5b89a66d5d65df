"""Connected components by local contractions (Lacki, Mirrokni, Wlodarczyk 2018)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import staged


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph with ``edges`` (u, v: long).

    Each round gives every node a pseudorandom priority, maps it to the node of least priority
    among itself and its neighbours, and contracts the edges along that map. The number of nodes
    with edges falls by a constant factor a round, so there are O(log n) rounds, each a few
    shuffles of what edges are left; a node's neighbours are never gathered, only minimised with
    partial aggregation. Every round is staged in the shared folder.

    Returns (node, root), one row for each node that has an edge to another node; nodes of one
    component have the same root, one of its nodes. Loops, repeated edges and edges with a null
    end add nothing; without edges the result is empty.
    """
    edges = staged(
        edges.select("u", "v").where(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        "edges",
    )
    maps = []
    for number in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(F.lit(number), F.col(c)).alias("p"), F.col(c).alias("n"))
        hop = staged(
            both.groupBy("u").agg(F.min(order("v")).alias("least"))
            .select(F.col("u").alias("node"), F.least("least", order("u"))["n"].alias("root")),
            "hop",
        )
        maps.append(hop)
        edges = staged(
            edges.join(hop.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
            .join(hop.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
            .where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
            "edges",
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = maps[0]
    for hop in maps[1:]:
        step = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found


def joined_components(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``parts`` (node, root), as ``connected_components`` gives them, with further ``edges`` (u, v): edges are taken between parts, of which there are fewer."""
    root = lambda end: parts.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    placed = edges.join(root("u"), "u", "left").join(root("v"), "v", "left").select("u", "v", F.coalesce("u_root", "u").alias("a"), F.coalesce("v_root", "v").alias("b"))
    placed = staged(placed, "edges-of-parts")
    joined = connected_components(placed.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("joined"))
    ends = placed.select(F.col("u").alias("node"), F.col("a").alias("root")).unionByName(placed.select(F.col("v").alias("node"), F.col("b").alias("root")))
    return parts.unionByName(ends).distinct().join(joined, "root", "left").select("node", F.coalesce("joined", "root").alias("root"))
