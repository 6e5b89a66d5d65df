"""Sharding by a hierarchical weighted hash tree, with gapless slots. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.prefix import BUCKETS, running_start
from tessera.llm.shared import staged, text_or_empty


@dataclass(frozen=True)
class Tree:
    """Regions of racks of (shard, weight); the weight of a rack or region is the sum of what it holds."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def balanced(shards: int, regions: int = 4, racks: int = 2) -> Tree:
        """Shards 0 to ``shards`` - 1 of equal weight, dealt in runs to regions and their racks."""
        cut = lambda ids, n: [ids[len(ids) * i // n : len(ids) * (i + 1) // n] for i in range(n)]
        return Tree(tuple(
            tuple(tuple((s, 1.0) for s in rack) for rack in cut(region, racks) if rack)
            for region in cut(list(range(shards)), regions) if region
        ))

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own.

        No weight inside an older region changes, so no row moves there: what moves, moves to the new shard.
        """
        new = sum(len(rack) for region in self.regions for rack in region)
        return Tree((*self.regions, (((new, weight),),)))

    def shard_of(self, key: Column) -> Column:
        """The shard of a key: at each level the child with the largest weighted draw ln(u) / weight, u in (0, 1).

        A draw depends on the key and the child alone, so a child's weight changes what it wins or
        loses itself, and nothing between the others. A region or rack is named by its place, a shard by its number.
        """
        weight = lambda node: sum(map(weight, node)) if isinstance(node[0], tuple) else node[1]

        def pick(path: tuple, children: list[tuple[object, float, Column]]) -> Column:
            children = [c for c in children if c[1] > 0]
            if not children:
                return F.lit(None).cast("int")
            if len(children) == 1:
                return children[0][2]
            draws = []
            for at, (name, w, _) in enumerate(children):
                bits = F.shiftrightunsigned(F.xxhash64(key, F.lit("/".join(map(str, (*path, name))))), 12)
                draws.append(F.struct((F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(w)).alias("draw"), F.lit(-at).alias("at")))
            best = F.greatest(*draws)["at"]
            chosen = F.when(best == 0, children[0][2])
            for at in range(1, len(children)):
                chosen = chosen.when(best == -at, children[at][2])
            return chosen

        regions = []
        for r, region in enumerate(self.regions):
            racks = []
            for k, rack in enumerate(region):
                shards = [(s, w, F.lit(s)) for s, w in rack]
                racks.append((k, sum(w for _, w in rack), pick(("shard", r, k), shards)))
            regions.append((r, sum(w for rack in region for _, w in rack), pick(("rack", r), racks)))
        return pick(("region",), regions)


def assign_shards(
    docs: DataFrame, shards: int = 16, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", *, buckets: int = BUCKETS
) -> DataFrame:
    """One row for each row of ``docs``: (``id_col``, size, text_crc32, law, shard, slot, grown_shard).

    The law is ``key``: the id and the tree decide on the shard. size: UTF-8 bytes of the text plus 1;
    text_crc32: of the same bytes, unsigned; slot: gapless from 0 in each shard; grown_shard: the
    shard when the tree has one more. Texts are read where they lie; only ids and numbers are shuffled. Slots follow the ids' hashes
    in ``buckets`` buckets, whatever the session's partitions.

    A null text has no bytes: size 1, checksum 0, as an empty one. A null id is a key like any other.
    Repeated rows go to one shard, in slots of their own. Other columns are not read. An empty input
    gives an empty result.
    """
    tree = tree or Tree.balanced(shards)
    key = F.col(id_col)
    text = text_or_empty(text_col)
    rows = docs.select(
        key, (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), tree.shard_of(key).alias("shard"), tree.grown().shard_of(key).alias("grown_shard"),
    )
    rows = staged(rows, "shards")
    return running_start(rows, "shard", [id_col, "text_crc32", "size"], F.lit(1), "slot", buckets).select(
        id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
