"""SimHash fingerprints and near-duplicate components within a few bits."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components, joined_components
from tessera.llm.numbered import list_parts, lists
from tessera.llm.prefix import spread_width
from tessera.llm.shared import forget, keep_last_staged, staged, staged_so_far, text_batches

BITS = 64
_CHUNK = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Longs of a text's parity map, and their columns.
MAP_LONGS = 8
_MAPS = [f"m{i}" for i in range(MAP_LONGS)]


def _fingerprint(text: str | None, shingle_words: int) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        hashes = [digest(joined, 42)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends)]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle_words - 1 :])]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at : at + _CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def simhash(text: Column, shingle_words: int = 5) -> Column:
    """64-bit SimHash of a text column, as a (signed) long.

    Lower-cases A-Z, takes the words between ASCII white space and hashes each run of
    ``shingle_words`` of them, repeats included, by XXH64 (seed 42); a text with fewer words is one
    shingle. A bit is set if it is set in over half of the hashes. Null, empty and blank texts
    give 0.
    """

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([_fingerprint(t.as_py(), shingle_words) for t in texts], pa.int64())

    return of(text)


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def block_masks(max_distance: int, blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - max_distance`` of the equal blocks that 64 bits split into.

    Two fingerprints within ``max_distance`` bits differ in at most that many blocks, so they agree
    under one of the masks.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - max_distance)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def tiled_pairs(rows: DataFrame, on: list[str], item: str, side: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(on, u, v, and each of ``also`` as u_ and v_): every pair u < v of the different ``item`` of ``rows`` equal in ``on``, once.

    ``members``, a column of ``rows``, is the number of rows equal in ``on``. These are dealt into groups of some ``side`` rows; each two groups, and each
    with itself, are a tile, which is a key of the join. So a crowded key is many small ones, and no pair is left out.
    """
    groups = F.ceil(F.col("members") / F.lit(side)).cast("int")
    dealt = rows.withColumns({"_groups": groups, "_own": F.pmod(F.xxhash64(item), groups).cast("int")})
    one = dealt.select(*on, F.col(item).alias("a"), F.struct(item, *also).alias("_one"), F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_groups") - 1)).alias("_j"))
    two = dealt.select(*on, F.col(item).alias("b"), F.struct(item, *also).alias("_two"), F.col("_own").alias("_j"), F.explode(F.sequence(F.lit(0), "_own")).alias("_i"))
    met = one.join(two, [*on, "_i", "_j"]).where(F.when(F.col("_i") == F.col("_j"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    less, more = F.least("_one", "_two"), F.greatest("_one", "_two")  # by the item, which differs
    return met.select(*on, less[item].alias("u"), more[item].alias("v"), *(less[c].alias(f"u_{c}") for c in also), *(more[c].alias(f"v_{c}") for c in also))


def hamming_links(prints: DataFrame, max_distance: int = 2, blocks: int = 4, bucket_cap: int = 16) -> DataFrame:
    """Links (u, v), each within ``max_distance`` bits, among ``prints``: one long column ``fp``, distinct, without null.

    Every fingerprint goes to one bucket for each choice of blocks that may agree. Buckets of up to ``bucket_cap``
    fingerprints are joined with themselves and each pair's distance is verified. No link is lost in larger ones:

    - For distances up to 2 their fingerprints are linked through what lies between them: each is sent to itself and to
      its 64 neighbours at one bit; two meet there if, and only if, they are within two bits. At most 65 different
      fingerprints can meet. The links are stars, so not all pairs are listed, but what is within reach is connected:
      components are exact, and the work is linear.
    - For longer distances a bucket is dealt into groups of some ``bucket_cap`` fingerprints, and every two groups
      meet in a tile of their own (``tiled_pairs``): all pairs are verified, and no task holds a bucket.
    """
    if not 0 < max_distance < blocks:
        raise ValueError("max_distance must be at least 1, and less than blocks")
    keys = F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(block_masks(max_distance, blocks))
    ]))
    # a few MB of fingerprints become many keys: dealt out first, or a task or two would make them all
    keyed = prints.repartition(spread_width(prints.sparkSession), "fp").select("fp", keys.alias("k")).select("fp", "k.choice", "k.key")
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("members")).where("members > 1")
    shared = staged(keyed.join(sizes, ["choice", "key"]), "simhash-buckets")
    close = hamming("u", "v") <= max_distance
    if max_distance > 2:
        return tiled_pairs(shared, ["choice", "key"], "fp", bucket_cap).where(close).select("u", "v").distinct()
    small, on = shared.where(F.col("members") <= bucket_cap), ["choice", "key"]
    pairs = small.select(*on, F.col("fp").alias("u")).join(small.select(*on, F.col("fp").alias("v")), on).where((F.col("u") < F.col("v")) & close).select("u", "v")
    crowded = shared.where(F.col("members") > bucket_cap)
    reach = F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in (0, *((1 << i) - (1 << BITS if i == BITS - 1 else 0) for i in range(BITS)))])
    met = crowded.select("fp").distinct().select("fp", F.explode(reach).alias("at")).groupBy("at").agg(F.collect_set("fp").alias("fps"))
    if max_distance == 1:  # only what meets at one of the two is at one bit
        met = met.where(F.array_contains("fps", F.col("at")))
        far = met.select(F.col("at").alias("u"), F.explode("fps").alias("v"))
    else:
        far = met.where(F.size("fps") > 1).select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
    return pairs.unionByName(far).where("u <> v").distinct()


def _runs(text: str | None, shingle_words: int) -> tuple[str, np.ndarray]:
    """A hash of the text in lower case (A-Z) and without its white space, and 64-bit hashes of its runs of words, repeats included.

    A run's hash is mixed from its words' hashes, so each word is hashed once; all words are one run, if they are fewer.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return "", np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle_words, len(words))
    count = len(words) - width + 1
    mixed = np.full(count, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ hashes[i : i + count]) * _ODD
        mixed ^= mixed >> np.uint64(29)
    return xxhash.xxh128_hexdigest(b" ".join(words)), mixed


def _different(runs: np.ndarray) -> np.ndarray:
    """Hashes once each, as signed longs in order."""
    return np.unique(runs.view(np.int64))


def _key(same: str) -> int:
    """A text's 64-bit key, as a signed long, from the hash that ``_runs`` gives (texts without words: 0)."""
    return int.from_bytes(bytes.fromhex(same[:16]), "little", signed=True)


def _long_lists(rows: list[np.ndarray]) -> pa.Array:
    return lists(np.cumsum([0, *map(len, rows)]), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _majority_bits(hashes: np.ndarray) -> int:
    """SimHash of hashes, as a signed long: bits that are set in over half."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _bits(rows: pa.Array) -> np.ndarray:
    """Of each list of hashes, ``MAP_LONGS`` longs whose bits say whether an odd number of its hashes fall on each: (rows, longs)."""
    values, ends = list_parts(rows)
    at = (values.to_numpy(zero_copy_only=False).view(np.uint64) * _ODD) >> np.uint64(64 - (MAP_LONGS * BITS - 1).bit_length())
    cell = np.repeat(np.arange(len(rows)), np.diff(ends)) * (MAP_LONGS * BITS) + at.astype(np.int64)
    odd = np.bincount(cell, minlength=len(rows) * MAP_LONGS * BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(-1, MAP_LONGS)


@dataclass(frozen=True)
class Prefix:
    """Prefix filter (Chaudhuri, Ganti, Kaushik 2006; by the pair's sizes, Xiao et al. 2008): which of its shingles a text looks others up by.

    In any one order of all shingles, a text need look up one more than it may lack: two texts alike share one that both look up.
    Rare shingles go first, those that no other text has foremost. So a text with more of its own than it may lack has no copy (``own_in_sample``, ``live``),
    and takes no further part: most texts. The rest look up what is rarest among them, ``crowd`` texts or more counting alike.
    Two texts that meet are a pair only if their places in the order, their sizes, and parity maps of what they have in common with any
    (bitmap filter: Sandes, Teodoro, Melo 2020) leave room for the similarity. All of these are bounds: no pair alike is left out.
    """

    min_similarity: float
    crowd: int = 64

    def may_lack(self, n: Column) -> Column:
        return (n - F.ceil(n * self.min_similarity - 1e-9)).cast("int")

    def sample_below(self) -> int:
        """Hashes (signed) under this are looked at first: half as many again as a text may lack, so one without copies shows by these alone."""
        return -(1 << 63) + min((1 << 64) - 1, int(1.5 * (1 - self.min_similarity) * (1 << 64)))

    def own_in_sample(self, seen: DataFrame) -> DataFrame:
        """(key, own): the number of a text's sampled shingles that no other text has. ``seen`` (key, sample); rows of one key are one text."""
        held = seen.select("key", F.explode("sample").alias("shingle"))
        owners = held.groupBy("shingle").agg(F.min("key").alias("key"), F.max("key").alias("other"))
        return owners.where("key = other").groupBy("key").agg(F.count("*").alias("own"))

    def live(self, kept: DataFrame) -> DataFrame:
        """(key, n, fp, s, shared, m0, m1...) of ``kept`` (key, n, fp, shingles), texts with few enough shingles of their own: ``shared`` are the ``s`` that others of ``kept`` have, rare ones first."""

        maps = ", ".join(f"m{i} long" for i in range(MAP_LONGS))

        @F.arrow_udf(maps)
        def parity(rows: pa.Array) -> pa.Array:
            bits = _bits(rows)
            return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(bits[:, i])) for i in range(MAP_LONGS)], [f"m{i}" for i in range(MAP_LONGS)])

        held = kept.select("key", F.explode("shingles").alias("shingle"))
        members = held.groupBy("shingle").agg(F.count("*").alias("members")).where("members > 1")
        ranked = held.join(members, "shingle").select("key", F.struct(F.least("members", F.lit(self.crowd)).cast("int").alias("members"), "shingle").alias("x"))
        shared = ranked.groupBy("key").agg(F.sort_array(F.collect_list("x"))["shingle"].alias("shared")).withColumn("s", F.size("shared"))
        enough = staged(kept.select("key", "n", "fp").join(shared, "key").where(F.col("n") - F.col("s") <= self.may_lack(F.col("n"))), "near-shared")
        return staged(enough.withColumn("m", parity("shared")).select("key", "n", "fp", "s", "shared", "m.*"), "near-live")

    def probes(self, live: DataFrame) -> DataFrame:
        """(shingle, pos, key, n, s, m0, m1...): what each text looks up, and its place among the text's shared shingles."""
        lookups = F.col("s") - (F.col("n") - self.may_lack(F.col("n"))) + 1
        return live.select(F.posexplode(F.slice("shared", F.lit(1), lookups)).alias("pos", "shingle"), "key", "n", "s", *_MAPS)

    def _may_be_alike(self) -> Column:
        """Whether texts a and b, which meet at a shingle that both look up, can share as many as the similarity takes of their numbers."""
        both = F.ceil((F.col("a.n") + F.col("b.n")) * (self.min_similarity / (1 + self.min_similarity)) - 1e-6)
        apart = sum((F.bit_count(F.col(f"a.{m}").bitwiseXOR(F.col(f"b.{m}"))) for m in _MAPS[1:]), F.bit_count(F.col(f"a.{_MAPS[0]}").bitwiseXOR(F.col(f"b.{_MAPS[0]}"))))
        return (F.col("a.pos") <= F.col("a.s") - both) & (F.col("b.pos") <= F.col("b.s") - both) & (F.col("a.s") + F.col("b.s") - apart >= 2 * both)

    def with_lead(self, probes: DataFrame) -> DataFrame:
        """(u, v): each text with one of those that look up the same shingle, the one with least of its own: it has the most copies, if any has."""
        lead = probes.groupBy("shingle").agg(F.min(F.struct(F.col("n") - F.col("s"), "key", "pos", "n", "s", *_MAPS)).alias("l")).select("shingle", "l.*")
        met = lead.alias("a").join(probes.alias("b"), "shingle").where((F.col("a.key") != F.col("b.key")) & self._may_be_alike())
        return met.select(F.least("a.key", "b.key").alias("u"), F.greatest("a.key", "b.key").alias("v")).distinct()

    def across(self, probes: DataFrame, parts: DataFrame, side: int) -> DataFrame:
        """(u, v): pairs of texts that look up one shingle and are in different ``parts`` (key, root; others are alone).

        Of the texts with a shingle, those outside its largest part meet all, dealt into groups of some ``side``; so a crowd of copies that are one
        part costs nothing, and no task holds a crowd.
        """
        rows = staged(probes.join(parts, "key", "left").withColumn("part", F.coalesce("root", "key")).drop("root"), "near-placed")
        counts = rows.groupBy("shingle", "part").agg(F.count("*").alias("texts"))
        largest = counts.groupBy("shingle").agg(F.max(F.struct("texts", "part"))["part"].alias("major"), F.count("*").alias("parts"), F.sum("texts").alias("texts"))
        groups = F.ceil(F.col("texts") / F.lit(side)).cast("int")
        split = rows.join(largest.where("parts > 1").select("shingle", "major", groups.alias("groups")), "shingle")
        everyone = split.withColumn("group", F.pmod(F.xxhash64("key"), F.col("groups")).cast("int"))
        outside = split.where("part <> major").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        once = (F.col("b.part") == F.col("b.major")) | (F.col("a.key") < F.col("b.key"))
        met = outside.alias("a").join(everyone.alias("b"), ["shingle", "group"]).where((F.col("a.part") != F.col("b.part")) & once & self._may_be_alike())
        return met.select(F.least("a.key", "b.key").alias("u"), F.greatest("a.key", "b.key").alias("v")).distinct()

    def alike(self, pairs: DataFrame, live: DataFrame) -> DataFrame:
        """Those of ``pairs`` (u, v: keys) whose Jaccard similarity of all shingles is ``min_similarity`` or more. What a text has for itself, no pair shares."""
        end = lambda key, n, shared: live.select(F.col("key").alias(key), F.col("n").alias(n), F.col("shared").alias(shared))
        sets = pairs.distinct().join(end("u", "u_n", "x"), "u").join(end("v", "v_n", "y"), "v")
        sizes = sets.select("u", "v", F.size(F.array_intersect("x", "y")).alias("both"), (F.col("u_n") + F.col("v_n")).alias("total"))
        return staged(sizes.where(F.col("both") >= self.min_similarity * (F.col("total") - F.col("both"))).select("u", "v"), "near-alike")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 5, min_similarity: float = 0.8, max_distance: int = 2, blocks: int = 4,
    crowd: int = 64, pairs_side: int = 512,
) -> DataFrame:
    """``docs`` without near copies: of each group of them the row of least id stays, with all its columns.

    Texts equal but for case (A-Z) and white space are one. Others are near copies if the Jaccard similarity of their
    runs of ``shingle_words`` words, all of them, is ``min_similarity`` or more. Groups are what such links connect; no link is missed or estimated.
    Texts and runs are known by 64-bit hashes.

    A text of which more runs are its own than a copy may lack is nobody's copy. A part of all hashes shows that of most texts; all runs of
    the others are made again, and counted among these. Of what then remains, candidates are texts whose SimHash fingerprints are within ``max_distance`` bits: close ones are
    found cheaply by blocks that agree, with keys of 32 bits for 2 bits, so their number stays in proportion. But fingerprints lie some 10 bits apart at a
    similarity of 0.8, which blocks of 64 bits cannot meet, so texts are candidates too if they look up a shingle together (``Prefix``), which all that are
    alike do. Texts near by fingerprint, and each text with one of a lookup, are compared first; what that
    connects is not paired again, so a large group of copies is never listed by its pairs.

    Texts without words are never copies of each other and all stay. Rows with a null id stay. Rows repeated with
    one id: all of the id that stays stay. An empty input gives an empty result.
    """
    spark, id_type, prefix = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), Prefix(min_similarity, crowd)
    text_batches(spark)
    before, below = staged_so_far(), prefix.sample_below()

    @F.arrow_udf("key long, fp long, n int, sample array<long>")
    def view(texts: pa.Array) -> pa.Array:
        keys, prints, counts, sampled = [], [], [], []
        for text in texts:
            same, runs = _runs(text.as_py(), shingle_words)
            different = _different(runs)
            keys.append(_key(same))
            prints.append(_majority_bits(runs))
            counts.append(len(different))
            sampled.append(different[: np.searchsorted(different, below)].copy())
        return pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(prints, pa.int64()), pa.array(counts, pa.int32()), _long_lists(sampled)], ["key", "fp", "n", "sample"])

    @F.arrow_udf("key long, shingles array<long>")
    def again(texts: pa.Array) -> pa.Array:
        rows = [_runs(t.as_py(), shingle_words) for t in texts]
        return pa.StructArray.from_arrays([pa.array([_key(r[0]) for r in rows], pa.int64()), _long_lists([_different(r[1]) for r in rows])], ["key", "shingles"])

    with_id = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(id_type).alias("id"), F.col(text_col).alias("text"))
    seen = staged(with_id.select("id", view("text").alias("v")).select("id", "v.*").where("n > 0"), "near-copies")
    names = staged(seen.select("id", "key"), "near-names")
    # one node for each different text, which the least id with it stands for
    texts = staged(seen.groupBy("key").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("fp", "n"))), "near-texts")
    own = prefix.own_in_sample(seen)
    asked = texts.join(own, "key", "left").where(F.coalesce("own", F.lit(0)) <= prefix.may_lack(F.col("n")))
    asked = staged(asked.select("id", F.col("key").alias("wanted"), "fp", "n"), "near-asked")
    forget(seen)
    # looked at after it is staged: as part of the join, shingles would be made of all texts
    made = staged(with_id.join(asked, "id").select("wanted", "fp", "n", again("text").alias("v")).select("wanted", "fp", "n", "v.*"), "near-shingles")
    live = prefix.live(made.where("key = wanted").dropDuplicates(["key"]).drop("wanted"))
    forget(made)
    probes = staged(prefix.probes(live), "near-probes")
    links = hamming_links(live.select("fp").distinct(), max_distance, blocks)
    by_print = live.groupBy("fp").agg(F.min("key").alias("lead"))
    # texts with one fingerprint are paired with their least; texts of linked fingerprints by the least of either
    inside = live.join(by_print, "fp").where("key <> lead").select(F.col("lead").alias("u"), F.col("key").alias("v"))
    across = (
        links.join(by_print.select(F.col("fp").alias("u"), F.col("lead").alias("a")), "u")
        .join(by_print.select(F.col("fp").alias("v"), F.col("lead").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    alike = prefix.alike(inside.unionByName(across).unionByName(prefix.with_lead(probes)), live)
    # different texts of one least id are one node
    shared_id = texts.groupBy("id").agg(F.min("key").alias("u"), F.count("*").alias("texts")).where("texts > 1")
    alike = alike.unionByName(texts.join(shared_id, "id").where("key <> u").select("u", F.col("key").alias("v")))
    found = staged(connected_components(alike).select(F.col("node").alias("key"), "root"), "near-found")
    rest = prefix.alike(prefix.across(probes, found, pairs_side), live)
    parts = joined_components(found.withColumnRenamed("key", "node"), rest).withColumnRenamed("node", "key")
    placed = staged(texts.select("key", "id").join(parts, "key", "left").select("key", "id", F.coalesce("root", "key").alias("root")), "near-parts")
    leads = staged(placed.join(placed.groupBy("root").agg(F.min("id").alias("lead")), "root").select("key", "lead"), "near-leads")
    drop = staged(names.join(leads, "key").where("id <> lead").select(F.col("id").alias("_drop_id")).distinct(), "near-drop")
    keep_last_staged(spark, before)
    return docs.join(drop, docs[id_col] == drop["_drop_id"], "left_anti").select(*docs.columns)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 3,
    max_distance: int = 2, blocks: int = 4,
) -> DataFrame:
    """One row for each row of ``docs``: (``id_col``, fingerprint: 16 hex digits, component_id).

    Rows whose fingerprints differ in at most ``max_distance`` bits are linked; component_id is the
    smallest id reachable over links, the row's own included. Equal fingerprints are one node, so
    copies are never paired. Null, empty and blank texts have fingerprint zero and are linked like
    any other. Rows with a null id keep a row, and take part in links, but name no component; a
    component of such rows alone has a null component_id. Repeated rows stay repeated. Other columns
    of ``docs`` are not read. An empty input gives an empty result.
    """
    text_batches(docs.sparkSession)
    prints = staged(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), shingle_words).alias("fp")), "simhash")
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    parts = connected_components(hamming_links(nodes.select("fp"), max_distance, blocks))
    rooted = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    least = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
