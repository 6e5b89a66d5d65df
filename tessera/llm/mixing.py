"""Mixing sources to target weights: blocks of words, drawn per output shard and joined by index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.prefix import BUCKETS, running_start, spread_width
from tessera.llm.shared import WORD_PATTERN, staged, text_or_empty

#: A word with the white space behind it.
_WORD_AND_SPACE = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)
    share_of_all: float = 1.5
    most_repeats: int = 2
    block_words: int = 64
    blocks_a_shard: int = 4096
    seed: int = 9
    max_sources: int = 100_000
    buckets: int = BUCKETS


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """Words to take of each source: by weight, none above ``most_repeats`` times its size.

    What a source cannot give is shared among the others by weight, until none is above.
    """
    found = [0.0] * len(sizes)
    weight = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    open_, left = [i for i, s in enumerate(sizes) if s], mix.share_of_all * sum(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        full = [i for i in open_ if left * weight[i] / total > mix.most_repeats * sizes[i]]
        if not full:
            for i in open_:
                found[i] = left * weight[i] / total
            break
        for i in full:
            found[i] = float(mix.most_repeats * sizes[i])
        left -= sum(found[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return found


def sources(spark: SparkSession, sized: DataFrame, mix: Mix) -> DataFrame:
    """A row for each source of ``sized`` (source, size), in order of code points, null last, with its target.

    One row of a few numbers for each source passes the driver; above ``max_sources`` that is an error.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(mix.max_sources + 1).collect()
    if len(totals) > mix.max_sources:
        raise ValueError(f"more than {mix.max_sources} sources; group them first")
    rows = sorted(((r["source"], int(r["size"])) for r in totals), key=lambda r: (r[0] is None, r[0] or ""))
    aims = targets([s for _, s in rows], mix)
    blocks = [-(-s // mix.block_words) for _, s in rows]
    slots = [round(aim * n / s) if s else 0 for aim, n, (_, s) in zip(aims, blocks, rows)]
    return spark.createDataFrame(
        [(name, i, size, aims[i], blocks[i], slots[i]) for i, (name, size) in enumerate(rows)],
        "source string, source_no int, source_size long, target double, blocks long, slots long",
    )


def _drawn(rng: np.random.Generator, good: int, others: int, take: int) -> int:
    """How many of ``good`` items are among ``take`` drawn from them and ``others``, without replacement (hypergeometric), for numbers of any size.

    Shares of the counts within 12 deviations of the mean, by the ratios of neighbours, and one number that falls among them; what lies further is less likely than a float can tell.
    """
    low, high = max(0, take - others), min(good, take)
    if low == high:
        return low
    total = good + others
    mean = take * (good / total)
    reach = 12 * np.sqrt(mean * (others / total) * ((total - take) / max(total - 1, 1))) + 12
    low, high = max(low, int(mean - reach)), min(high, int(mean + reach) + 1)
    k = np.arange(low, high, dtype=float)
    ratio = ((good - k) / (k + 1)) * ((take - k) / (others - take + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def _split(counts: np.ndarray, left: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many of each source's ``counts`` items go to the ``left`` first places, at random."""
    rng, taken, rest = np.random.default_rng(seed), np.zeros_like(counts), int(counts.sum())
    for s, own in enumerate(counts.tolist()):
        rest -= own
        taken[s] = _drawn(rng, own, rest, left)
        left -= int(taken[s])
    return taken


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """For one output shard: its number of slots of each source, and how many earlier shards have.

    Multinomial counts given that over all shards they add up to ``slots``: the shards are halved again
    and again, and each half's counts are drawn without replacement from their parent's. A draw is seeded
    by its place, so every task finds the same counts without the others. ``known`` has the draws on the way to the last shard, which are most of those on the way to the next.
    """
    total = int(slots.sum())
    bound = lambda i: total * i // shards
    low, high, counts, before = 0, shards, slots, np.zeros_like(slots)
    way = {}
    while high - low > 1:
        middle = (low + high) // 2
        if (low, high) not in known:
            known[low, high] = _split(counts, bound(middle) - bound(low), (seed, low, high))
        first = way[low, high] = known[low, high]
        if shard < middle:
            high, counts = middle, first
        else:
            low, counts, before = middle, counts - first, before + first
    known.clear()
    known.update(way)
    return counts, before


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Each of ``i``, below ``n``, under a pseudorandom permutation of range(n): a Feistel network, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(1, 2**63, size=6, dtype=np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= k
            a, b = b, a ^ ((mixed >> np.uint64(32)) & mask)
        return (a << np.uint64(half)) | b

    out = once(i.astype(np.uint64))
    while len(over := np.flatnonzero(out >= n)):
        out[over] = once(out[over])
    return out.astype(np.int64)


def draw_slots(spark: SparkSession, table: DataFrame, mix: Mix) -> DataFrame:
    """(shard, slot, source_no, block): every place of the mixed corpus, and the block that fills it."""
    rows = table.orderBy("source_no").select("blocks", "slots").collect()  # at most max_sources
    blocks, slots = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("blocks", "slots"))
    shards = max(1, -(-int(slots.sum()) // mix.blocks_a_shard))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                counts, before = shard_counts(slots, shards, shard, mix.seed, known)
                of = np.repeat(np.arange(len(counts)), counts)
                index = np.concatenate([np.arange(b, b + c) for b, c in zip(before, counts)] or [np.zeros(0, np.int64)])
                block = np.empty(len(index), np.int64)
                for s in np.flatnonzero(counts):
                    mine = of == s
                    turn, place = np.divmod(index[mine], blocks[s])
                    found = np.empty(len(place), np.int64)
                    for t in np.unique(turn):
                        found[turn == t] = permuted(place[turn == t], int(blocks[s]), (mix.seed << 40) + (int(s) << 8) + int(t))
                    block[mine] = found
                order = np.random.default_rng((mix.seed, shard, 1)).permutation(len(index))
                columns = {"shard": np.full(len(index), shard), "slot": np.arange(len(index), dtype=np.int32), "source_no": of[order].astype(np.int32), "block": block[order]}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    parts = max(1, min(shards, spread_width(spark)))
    return spark.range(0, shards, 1, parts).mapInArrow(draw, "shard long, slot int, source_no int, block long")


def placed_documents(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Ids and figures of documents, with their source's and their place among its words; and the sources. Texts are read, but stay where they are."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_or_empty(text_col), F.lit(WORD_PATTERN)).cast("long").alias("size"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"),
    )
    rows = staged(rows, "mix")
    table = sources(docs.sparkSession, rows, mix)
    known = rows.alias("r").join(F.broadcast(table.alias("s")), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "source_no", "source_size", "target")
    return staged(running_start(known, "source_no", ["doc_id", "text_hash", "size"], F.col("size"), "start", mix.buckets), "mix-placed"), table


def pieces(placed: DataFrame, table: DataFrame, mix: Mix) -> DataFrame:
    """Every piece of a document that the mix takes, once for each time: placed's columns, shard, slot, first_word, words."""
    length = mix.block_words
    block = F.explode(F.sequence(F.expr(f"start div {length}"), F.expr(f"(start + size - 1) div {length}")))
    low = F.greatest("start", F.col("block") * length)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * length)
    parts = placed.where("size > 0").withColumn("block", block).withColumn("first_word", low - F.col("start")).withColumn("words", high - low)
    # slots grow with the corpus, which Spark cannot see from the few shards that they are drawn for: never broadcast them
    return parts.join(draw_slots(placed.sparkSession, table, mix).hint("merge"), ["source_no", "block"])


def _text_key(doc_id: Column, source: Column, text_hash: Column) -> list[Column]:
    """128 bits that stand for a text of a document, never null, so rows are dealt by them once for grouping and joining."""
    named = [doc_id.isNull(), doc_id, source.isNull(), source, text_hash]
    return [F.xxhash64(*named).alias("key_a"), F.xxhash64(F.lit(9), *named).alias("key_b")]


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, carry: tuple[str, ...] = ()) -> DataFrame:
    """The mixed corpus: (shard, slot, doc_id, source, first_word, words, text, and columns to ``carry``), a row for each piece of a block.

    Each source's words, in a fixed pseudorandom order of its documents, are cut to blocks of ``block_words``. Sources
    by code point, null last, weigh ``weights``, repeating, and share ``share_of_all`` times all words, no
    source above ``most_repeats`` times its own. Output shards of ``blocks_a_shard`` blocks draw multinomial counts
    of sources that add up to the targets; the slots of a source, counted through all shards, run
    through a pseudorandom permutation of its block indexes, a new one each time it has been through,
    so no block is taken more than ``most_repeats`` times. Blocks are joined by index. Text keeps the white
    space behind each word. The same rows give the same mix, whatever the partitions of session and table.

    Null, empty and blank texts have no words and give no piece. Null sources are a source; null ids and
    repeated rows take part like others; of carried columns they get the least. Others are not read. Numbers are placed and joined by
    themselves; a text is moved once. An empty input gives an empty result.
    """
    placed, table = placed_documents(docs, mix, id_col, text_col, source_col)
    key = ["key_a", "key_b"]
    piece = F.struct("shard", "slot", "first_word", "words")
    # a row's pieces are at most ``most_repeats`` times its blocks; repeated rows differ in start
    wanted = pieces(placed, table, mix).select(*_text_key(F.col("doc_id"), F.col("source"), F.col("text_hash")), "start", "doc_id", "source", piece.alias("piece"))
    wanted = wanted.groupBy(*key, "start").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.collect_list("piece").alias("pieces"))
    text = text_or_empty(text_col)
    texts = docs.select(*_text_key(F.col(id_col), F.col(source_col).cast("string"), F.xxhash64(text)), text.alias("text"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry))).groupBy(*key).agg(F.first("text").alias("text"), *(F.min(f"carry_{i}").alias(f"carry_{i}") for i in range(len(carry))))
    cut = lambda found: F.transform("pieces", lambda p: p.withField("text", F.array_join(F.slice(found, (p["first_word"] + 1).cast("int"), p["words"].cast("int")), "")))
    found = F.transform(F.array(F.regexp_extract_all("text", F.lit(_WORD_AND_SPACE), F.lit(0))), cut)
    own = [f"carry_{i}" for i in range(len(carry))]
    out = wanted.join(texts.hint("merge"), key).select("doc_id", "source", *own, F.explode(F.get(found, F.lit(0))).alias("p"))
    return out.select("p.shard", "p.slot", "doc_id", "source", "p.first_word", "p.words", "p.text", *(F.col(o).alias(c) for o, c in zip(own, carry)))


def mix_report(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: (doc_id, size, source_size, target, taken), of the mix that ``mix_sources`` makes.

    size: words of the text (none if null); target: words to take of its source; taken: words of the document in
    the mix, repeats counted. It joins the same blocks to the same slots, but leaves the texts where they are.
    """
    placed, table = placed_documents(docs, mix, id_col, text_col, source_col)
    taken = pieces(placed, table, mix).groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    with_words = placed.where("size > 0").join(taken, ["source_no", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return with_words.unionByName(placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
