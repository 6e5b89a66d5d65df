"""Alignment of two tokenizers' tokens by the bytes they cover: groups, links, and how often pairs of ids are linked over the corpus."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.numbered import lists
from tessera.llm.shared import staged, text_batches

#: A text is split by tiktoken, whose pattern steps once for each character, up to this many characters; longer ones go to the tokenizers library.
_SPLIT_CHARACTERS = 200_000



class Encoder(NamedTuple):
    """ids of a text, each id's bytes, and whether tokens can only leave text out, never change it: then they are whole if they are as long."""

    ids: Callable[[str], list[int] | np.ndarray]
    pieces: list[bytes]
    cuts: bool

    def whole(self, ids: list[int] | np.ndarray, length: int, data: bytes) -> bool:
        return length == len(data) and (self.cuts or b"".join(map(self.pieces.__getitem__, ids)) == data)


@dataclass(frozen=True)
class ByteLevel:
    """A byte-level BPE in a file of the tokenizers library. ``pattern``: what its pre-tokenizer splits by, if known: plain files of this kind are then encoded by tiktoken, with the same ids."""

    path: str
    pattern: str | None = None

    def load(self) -> Encoder:
        return _byte_level(self.path, self.pattern)


@dataclass(frozen=True)
class Pieces:
    """A sentencepiece model with byte fallback. It puts a space before a text itself."""

    path: str

    def load(self) -> Encoder:
        return _pieces(self.path)


def _byte_alphabet() -> dict[str, int]:
    """Byte-level files write a byte as a character: printable ones of Latin-1 as themselves, the others in order from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _is_plain(file: dict) -> bool:
    """Whether ids are the ranks of merges over bytes, and nothing but the known pattern stands before them."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", []))
    settings = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return settings and split and file.get("normalizer") is None and all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merged))


@lru_cache(maxsize=4)
def _byte_level(path: str, pattern: str | None) -> Encoder:
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as lines:
        file = json.load(lines)
    byte = _byte_alphabet()
    pieces = {i: bytes(byte[c] for c in piece) for piece, i in file["model"]["vocab"].items()}
    library = Tokenizer.from_str(json.dumps(file))
    library.encode_special_tokens = True
    encode = lambda text: library.encode(text, add_special_tokens=False).ids
    if pattern and _is_plain(file):
        import tiktoken

        fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks={piece: i for i, piece in pieces.items()}, special_tokens={})
        slow, encode = encode, lambda text: fast.encode_to_numpy(text, disallowed_special=()) if len(text) <= _SPLIT_CHARACTERS else slow(text)
    return Encoder(encode, [pieces.get(i, b"") for i in range(max(pieces, default=-1) + 1)], _is_plain(file))


@lru_cache(maxsize=4)
def _pieces(path: str) -> Encoder:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return Encoder(lambda text: model.encode(text, num_threads=1), [of(i) for i in range(model.vocab_size())], False)


@dataclass(frozen=True)
class Vocabularies:
    """Both vocabularies' ids: the bytes of each, and each as it is written, before a comma and as a group's last (``|`` behind the first, ``;`` behind the second)."""

    sizes: tuple[np.ndarray, np.ndarray]
    written: pa.Array

    @classmethod
    def of(cls, pieces: tuple[list[bytes], list[bytes]]) -> Vocabularies:
        written = [f"{i}{end}".encode() for own, last in zip(pieces, "|;") for i in range(len(own)) for end in (",", last)]
        return cls(tuple(np.array([len(p) for p in own], np.int64) for own in pieces), pa.array(written, pa.large_binary()))


def _digest(a_rows: list[np.ndarray], b_rows: list[np.ndarray], known: Vocabularies, crowd: int, pair: pa.DataType) -> list[pa.Array]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs, times and crowded of rows of ids, all rows of a batch at once.

    A group ends where tokens of both do. A pair of ids is one number, first * (ids of the second) + second; a row has its different ones, ascending, and how often each
    is linked. Rows with a group of more than ``crowd`` links keep their groups as they are instead (``crowded``).
    """
    n, (many, width) = len(a_rows), map(len, known.sizes)
    none = np.zeros(0, np.int64)
    (a, n_a, row_a, ends_a), (b, n_b, row_b, ends_b) = (
        (ids := np.concatenate([none, *rows]), count := np.fromiter(map(len, rows), np.int64, n), row := np.repeat(np.arange(n), count), np.cumsum(sizes[ids]) + row)  # a byte between rows
        for rows, sizes in zip((a_rows, b_rows), known.sizes)
    )
    reached = np.zeros(int(ends_a[-1]) + 1 if len(a) else 0, bool)
    reached[ends_a] = True
    cuts = ends_b[reached[ends_b]]
    cuts = cuts[np.diff(cuts, prepend=-1) > 0]
    x, y = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
    own_a, own_b = np.diff(x, prepend=0), np.diff(y, prepend=0)
    first_a, first_b, row, linked = x - own_a, y - own_b, row_a[x - 1], own_a * own_b

    code = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[x - 1] = last_b[y - 1] = 1
    code[np.arange(len(a)) + np.repeat(first_b, own_a)] = 2 * a + last_a
    code[np.arange(len(b)) + np.repeat(x, own_b)] = 2 * (many + b) + last_b
    written = known.written.take(pa.array(code))
    at = np.frombuffer(written.buffers()[1], np.int64, len(code) + 1)[np.cumsum([0, *(n_a + n_b)])].tolist() if len(code) else [0] * (n + 1)
    data = memoryview(written.buffers()[2] or b"")
    hashes = [hashlib.sha256(data[low : high - 1]).hexdigest() if high > low else "" for low, high in zip(at, at[1:])]

    crowded = np.zeros(n, bool)
    crowded[row[linked > crowd]] = True
    whole = crowded[row]
    fa, fb, ob, links = (of[~whole] for of in (first_a, first_b, own_b, linked))
    group = np.repeat(np.arange(len(links)), links)
    within = np.arange(len(group)) - (np.cumsum(links) - links)[group]
    down = within // ob[group]
    span = many * width
    key = row[~whole][group] * span + a[fa[group] + down] * width + b[fb[group] + within - down * ob[group]]
    key.sort()
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    rows = key[starts] // span
    offsets = np.searchsorted(rows, np.arange(n + 1))
    pairs, times = pa.array(key[starts] - rows * span).cast(pair), pa.array(np.diff(starts, append=len(key)).astype(np.int32))
    sides = [lists(np.cumsum([0, *own[whole]]), pa.array(ids[crowded[of]].astype(np.int32))) for own, ids, of in ((own_a, a, row_a), (own_b, b, row_b))]
    kept = lists(np.cumsum([0, *np.bincount(row[whole], minlength=n)]), pa.StructArray.from_arrays(sides, ["a", "b"]))
    counts = n_a, n_b, np.bincount(row, minlength=n), np.bincount(row, linked, n).astype(np.int64)
    return [*map(pa.array, counts), pa.array(hashes, pa.string()), lists(offsets, pairs), lists(offsets, times), kept]


def _aligned(docs: DataFrame, first: ByteLevel, second: Pieces, pair: str, crowd: int, id_col: str, text_col: str) -> DataFrame:
    """(id, and what ``_digest`` gives) of a space and the text. Empty where there is no text, or where tokens do not join to just that."""
    text_batches(docs.sparkSession, 2)
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "crowded"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = first.load(), second.load()
        known, none = Vocabularies.of((coders[0].pieces, coders[1].pieces)), np.zeros(0, np.int64)
        for batch in batches:
            rows: tuple[list[np.ndarray], ...] = ([], [])
            for value in batch.column("text"):
                text = value.as_py() or ""
                whole = (" " + text).encode() if text else b""
                found = (coders[0].ids(" " + text), coders[1].ids(text)) if text else ([], [])
                ids = [np.asarray(f, np.int64) for f in found]
                if not all(coder.whole(f, int(size[i].sum()), whole) for coder, f, i, size in zip(coders, found, ids, known.sizes)):
                    ids = [none, none]
                for side, i in zip(rows, ids):
                    side.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_digest(*rows, known, crowd, pa.int32() if pair == "int" else pa.int64())], ["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"{c} bigint" for c in names[:4])
    return rows.mapInArrow(encode, f"id {kind}, {counts}, groups_sha256 string, pairs array<{pair}>, times array<int>, crowded array<struct<a:array<int>,b:array<int>>>")


def _linked_pairs(coded: DataFrame, width: int, pair: str) -> DataFrame:
    """(row, pair, times): the pairs that each text links, once each. Crowded texts count ids within each group first, so a group's links are never listed."""
    few = coded.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times")))
    groups = coded.where(F.size("crowded") > 0).select("row", F.posexplode("crowded").alias("group", "g"))
    counted = lambda side: groups.select("row", "group", F.explode(f"g.{side}").alias(side)).groupBy("row", "group", side).agg(F.count("*").alias(f"n_{side}"))
    met = counted("a").join(counted("b"), ["row", "group"])
    many = met.groupBy("row", (F.col("a") * F.lit(width).cast(pair) + F.col("b")).cast(pair).alias("pair")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("times"))
    return few.select("row", "pair", F.col("times").cast("bigint").alias("times")).unionByName(many)


def align(
    docs: DataFrame, first: ByteLevel, second: Pieces, id_col: str = "doc_id", text_col: str = "text", *, crowd: int = 64, frequent: int = 100_000,
) -> DataFrame:
    """(``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``docs``.

    Texts, after a space, are tokenised by both; byte offsets where tokens of both end cut them into groups, and all tokens of a group are linked with each other. A pair of ids counts in how many
    rows of the corpus it is linked. n_best: links whose count is the highest of their first id's; count_sum: of all links. groups_sha256 is of the groups' ids, ``a1,a2|b1;a3|b2,b3``.

    Texts are tokenised, and their groups and links made, in batches of Arrow by numpy (``_digest``), and staged with each row's different pairs. Their counts, one row for each pair, are then met with
    the pairs of all rows: pairs that are among 1 / ``frequent`` or more of all (row, pair) - so at most ``frequent`` pairs, whatever the corpus - are broadcast, and take most rows
    without a shuffle; the others, of which none is frequent, are joined by a shuffle. A text with a group of more than ``crowd`` links (one without common ends
    for long) is counted by joins instead of arrays.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros, and an empty groups_sha256. A null id keeps its row; repeated rows
    stay repeated, and each counts; other columns are not read. An empty input gives an empty result.
    """
    width, many = len(second.load().pieces), len(first.load().pieces)
    pair = "int" if width * many < 2**31 else "bigint"
    coded = _aligned(docs, first, second, pair, crowd, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    # numbered where it is written, so that the numbers stay; ascending pairs are small as differences
    coded = staged(coded, "aligned", **{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"})
    linked = _linked_pairs(coded, width, pair)
    counts = staged(linked.groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    best = counts.groupBy(F.floor(F.col("pair") / width).cast("int").alias("a")).agg(F.max("n").alias("most"))  # a row for each id of the first vocabulary
    judged = counts.join(F.broadcast(best), F.floor(F.col("pair") / width).cast("int") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * frequent >= F.lit(total).cast("bigint")
    sums = lambda met: met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    frequently = sums(linked.join(F.broadcast(judged.where(often)), "pair"))
    rarely = linked.join(F.broadcast(judged.where(often).select("pair")), "pair", "left_anti")
    rarely = sums(rarely.join(judged.where(~often).hint("shuffle_hash"), "pair"))
    both = frequently.unionByName(rarely).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    out = coded.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(both, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
