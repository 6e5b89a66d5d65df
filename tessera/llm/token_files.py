"""Token ids of documents in Parquet files, in order of ids, with selective reads of tokens and of figures about them."""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.numbered import NumberedIds, list_parts, lists
from tessera.llm.shared import staged_path, text_batches

SCHEMA = "doc_id long, shard int, start_in_shard long, n_tokens int, ids array<int>"


@dataclass(frozen=True)
class Layout:
    """How the files are cut: row groups, pages and, for each page, an index entry of its bounds.

    Ids are dictionary-encoded while a row group's dictionary fits its page, and delta-encoded otherwise, as are the
    counts, which version 2 of the format's writer does; pages end after ``page_rows`` documents at most, so
    a few documents' ids can be read through the page index without the rest of their row group.
    """

    row_group_bytes: int = 16 << 20
    page_bytes: int = 128 << 10
    page_rows: int = 512
    dictionary: bool = True

    def options(self) -> dict[str, str]:
        return {
            "parquet.block.size": str(self.row_group_bytes), "parquet.page.size": str(self.page_bytes), "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.enable.dictionary": str(self.dictionary).lower(), "parquet.dictionary.page.size": str(1 << 20), "parquet.writer.version": "v2",
            "compression": "zstd",
        }


#: What Python's split takes for white space, but the tokenizer does not.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
_SPECIAL = "<|"
#: The first letter whose lower case is more than one character; what lies before it is composed, too.
_LATIN_END = "\u0130"


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The library's tokenizer of a file, its pattern of pieces, and Latin letters in its model's alphabet (as the library's byte level gives them)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer, level = Tokenizer.from_file(path), ByteLevel(add_prefix_space=False, use_regex=False)
    pattern = json.loads(tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(128, ord(_LATIN_END)) if chr(c).isalpha()}
    return tokenizer, regex.compile(pattern).findall, letters


@contextmanager
def no_cycles() -> Iterator[None]:
    """Without the search for cycles, which would go through all known words again and again, and finds none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class WordEncoder(dict):
    """Encodes whole texts by a tokenizer file whose tokens never span white space: every different word by the library, once.

    Its pre-tokenizer drops white space, so a text's ids are its words' ids, one after the other. The dictionary gives words their numbers,
    by which ids are looked up, for a run of texts at once. Its normalizer composes and folds case, and its pre-tokenizer cuts words to pieces by a
    pattern; so a Latin word shares its number with its lower-case form, whose ids are its pieces' ids.
    Lower-case Latin letters pass both unchanged, as one piece, so the library's model is asked for their ids directly; all else goes through the
    whole library. When over ``remember`` words are known, only the first ``keep`` numbers stay: words that occur early are those that occur often.
    """

    def __init__(self, path: str, remember: int = 700_000, keep: int = 350_000):
        self.remember, self.keep = remember, keep
        self.tokenizer, self.find, self.letters = _tokenizer(path)
        self.model = self.tokenizer.model
        self.none_of = re.compile(f"[^{_NO_SPACE}]*").fullmatch
        # how many words have ids; what those after them are made of (None: one of the lower-case letters' words, which are in order)
        self.ids, self.known, self.made, self.lower = NumberedIds(), 0, [], []

    def _forget(self) -> None:
        kept = {word: number for word, number in self.items() if number < self.keep}
        self.clear()
        self.update(kept)
        self.ids.forget(self.keep)
        self.known = len(self.ids.lengths)

    def __missing__(self, word: str) -> int:
        plain = word.isascii()
        if plain or max(word) < _LATIN_END:
            letters = word.isalpha()
            if letters or _SPECIAL not in word:
                low = word.lower()
                if low != word:
                    number = self[word] = self[low]
                    return number
                if letters:
                    self.lower.append(word if plain else word.translate(self.letters))
                    return self._number(word, None)
                if self.none_of(word):
                    pieces = self.find(word)
                    if pieces != [word]:
                        return self._number(word, tuple(map(self.__getitem__, pieces)))
        return self._number(word, word)

    def _number(self, word: str, made_of) -> int:
        number = self[word] = self.known + len(self.made)
        self.made.append(made_of)
        return number

    def _learn(self) -> None:
        tokenize = self.model.tokenize
        lower = iter([[t.id for t in tokenize(w)] for w in self.lower])
        others = iter(self.tokenizer.encode_batch_fast([m for m in self.made if isinstance(m, str)], add_special_tokens=False))
        before, new = self.known, []
        of = lambda n: new[n - before] if n >= before else self.ids.flat[(at := self.ids.starts[n]) : at + self.ids.lengths[n]].tolist()
        for m in self.made:
            new.append(next(lower) if m is None else next(others).ids if isinstance(m, str) else list(chain.from_iterable(map(of, m))))
        self.ids.add(np.fromiter(chain.from_iterable(new), np.int32), np.fromiter(map(len, new), np.int64, len(new)))
        self.made, self.lower, self.known = [], [], len(self.ids.lengths)

    def encode_flat(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's end."""
        if len(self) > self.remember:
            self._forget()
        with no_cycles():
            return self._encode_flat(texts)

    def _encode_flat(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        numbers, ends = array("i"), [0]
        for text in texts:
            text = text or ""
            words = text.split() if not any(c in text for c in _NO_SPACE) else text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            numbers.extend(map(self.__getitem__, words))
            ends.append(len(numbers))
        if self.made:
            self._learn()
        ids, upto = self.ids.of(np.array(numbers, np.int32))
        return ids, np.concatenate([[0], upto])[ends[1:]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_flat(texts)
        return _cut(ids.tolist(), ends.tolist())


class LibraryEncoder:
    """Encodes whole texts by any tokenizer file, through the library alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode_flat(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.cumsum(list(map(len, found)), dtype=np.int64)


def goes_by_words(file: dict) -> bool:
    """Whether a tokenizer file is of the kind that ``WordEncoder`` knows: texts composed, white space made one, and in lower case; pieces of a pattern, the rest dropped; byte-level BPE."""
    normalizers = (file.get("normalizer") or {}).get("normalizers", [])
    before = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n.get("type") for n in normalizers] != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in before] != ["Split", "ByteLevel"]:
        return False
    spaces, (split, level) = normalizers[1], before
    return (
        spaces.get("pattern") == {"Regex": r"\s+"} and spaces.get("content") == " " and "Regex" in split.get("pattern", {}) and split.get("behavior") == "Removed" and split.get("invert") is True
        and not level.get("add_prefix_space") and not level.get("use_regex") and file["model"].get("type") == "BPE" and all(t.get("special") and not t.get("normalized") and t["content"].startswith(_SPECIAL) for t in file.get("added_tokens", []))
    )


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> WordEncoder | LibraryEncoder:
    """One encoder for a worker, with the words that it knows, for all of its tasks: by words where the file is of that kind, else by the library throughout."""
    with open(path, encoding="utf-8") as lines:
        return WordEncoder(path) if goes_by_words(json.load(lines)) else LibraryEncoder(path)


def _cut(ids: list[int], ends: list[int]) -> list[list[int]]:
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


def _runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Rows from and to, in runs of up to about ``most`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        last = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield at, last
        at = last


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", *, layout: Layout = Layout(), bytes_at_once: int = 4 << 20) -> None:
    """Writes SCHEMA for all rows of ``docs``: their whole texts' ids and ``end_id`` behind them.

    Rows are dealt to shards by range of their id (null first; equal ids by a hash of the text), and sorted in
    them; shard and place in the shard give the order over all files. Sorting moves each text once.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in _runs(batch.column("text"), bytes_at_once):
                ids, ends = encoder.encode_flat(t.as_py() for t in batch.column("text").slice(a, b - a))
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                begins = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, shard, np.int32)), pa.array(start + begins), pa.array((ends - begins).astype(np.int32)),
                    lists([0, *ends], pa.array(ids)),
                ], ["doc_id", "shard", "start_in_shard", "n_tokens", "ids"])
                start += int(ends[-1])

    text_batches(docs.sparkSession)
    order = ["doc_id", "text_hash"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(encode, SCHEMA).write.options(**layout.options()).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The files' rows, or some of their columns only: without ``ids`` no token is read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.select(*columns) if columns else rows


def document_tokens(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Ids of documents ``first`` to ``last``: bounds of row groups and pages keep the rest from being read."""
    return read_tokens(spark, path, ["doc_id", "ids"]).where(F.col("doc_id").between(first, last))


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def of(rows: pa.Array) -> pa.Array:
        values, offsets = list_parts(rows)
        values = values.to_numpy(zero_copy_only=False).astype("<u4")
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.int64())

    return of(ids)


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start: ids of all before it.

    A first read, of two small columns, finds where shards start: one number for each shard reaches the driver.
    """
    totals = read_tokens(spark, path, ["shard", "n_tokens"]).groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    starts, at = [], 0
    for row in totals:
        starts.append((row["shard"], at))
        at += row["n"]
    first = spark.createDataFrame(starts, "shard int, shard_start long")
    return read_tokens(spark, path).join(F.broadcast(first), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), ids_crc32(F.col("ids")).alias("ids_crc32")
    )


def tokenize_to_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", *, layout: Layout = Layout()) -> DataFrame:
    """Writes the ids of ``docs`` to new files in the shared folder, and reports on them as read back.

    One row for each row of ``docs``. Null, empty and blank texts have the end id alone. Null ids come first; repeated
    rows stand side by side. Other columns are not read. An empty input gives an empty result.
    """
    path = staged_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, id_col, text_col, layout=layout)
    return token_report(docs.sparkSession, path).withColumnRenamed("doc_id", id_col)
