"""Byte-level BPE: ranked merges folded by Spark's higher-order functions over distinct words, and decoding."""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.numbered import NumberedIds, list_parts, lists
from tessera.llm.shared import text_batches

#: Bits of an id, of a piece's place in its word, and (above them) of a rank in an entry of the fold's state.
_ID, _PLACE = 20, 16
_NO_RANK, _EDGE = (1 << 21) - 1, (1 << _ID) - 1
_SECOND_CHOICE = 40
#: Bytes of a word that have a place of their own, between the two edges.
_EDGE_PLACE = (1 << _PLACE) - 2


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used: what a fold of nothing begins, and ends, with."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, use)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


class Merges:
    """A vocabulary's ranked merges as a literal map, and the fold over a word's bytes that applies them.

    The map goes from two neighbours' ids to the rank of what they join to, which is its id too. Spark looks a map up by walking
    it, so the literal is a flat array: a pair is in one of the two places that its hash names (cuckoo hashing), with its
    rank in the low bits. Pairs of bytes have a table of their own, without hashes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= min(_NO_RANK, _EDGE):
            raise ValueError("ranks do not fit the fold's state")
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << _ID | b] = rank
        size = 16
        while size < 2 * len(pairs):
            size *= 2
        while (places := self._place(list(pairs), size)) is None:
            size *= 2
        self._mask = size - 1
        literal = lambda row: F.from_json(F.lit(json.dumps(row, separators=(",", ":"))), "array<bigint>")
        self._tables = F.struct(
            literal([None if k is None else k << _ID | pairs[k] for k in places]).alias("pairs"),
            literal([ranks.get(bytes([b]), _EDGE) for b in range(256)]).alias("bytes"),
            literal([ranks.get(bytes([a, b])) for a in range(256) for b in range(256)]).alias("first"),
        )

    @staticmethod
    def _place(keys: list[int], size: int) -> list[int | None] | None:
        """Cuckoo hashing by XXH64 (seed 42, as Spark's xxhash64 of a long): the key in each place."""
        hashes = [xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42) for k in keys]
        choices = {k: (h & (size - 1), (h >> _SECOND_CHOICE) & (size - 1)) for k, h in zip(keys, hashes)}
        places: list[int | None] = [None] * size
        for key in keys:
            at = choices[key][0]
            for _ in range(500):
                key, places[at] = places[at], key
                if key is None:
                    break
                at = choices[key][1] if at == choices[key][0] else choices[key][0]
            else:
                return None
        return places

    def _rank(self, t: Column, a: Column, b: Column) -> Column:
        """The rank of neighbours with ids ``a`` and ``b`` (longs)."""

        def look_up(key: Column) -> Column:
            hashed = F.xxhash64(key)
            entry = lambda place: F.get(t["pairs"], place.bitwiseAND(F.lit(self._mask)).cast("int"))
            or_else = lambda e, other: F.when(F.shiftright(e, _ID) == key, e.bitwiseAND(F.lit(_EDGE))).otherwise(other)
            return or_else(entry(hashed), or_else(entry(F.shiftrightunsigned(hashed, _SECOND_CHOICE)), _long(_NO_RANK)))

        return _bound(F.shiftleft(a, _ID).bitwiseOR(b), look_up)

    def _fold(self, t: Column, word: Column) -> Column:
        """A fold over the bytes of a word: joins the neighbours of least rank, the first of equals, until none join to a piece.

        The state is an array of longs, one for each piece between two edges: the rank of the piece joined with the next,
        its place in the word, and its id, so the least entry is the pair to join. A step looks up two new ranks and
        copies the array; a word of n bytes takes at most n steps of O(n).
        """
        high = _ID + _PLACE
        edge = lambda place: F.array(_long(_NO_RANK << high | place << _ID | _EDGE))
        id_of = lambda e: e.bitwiseAND(F.lit(_EDGE))
        low_of = lambda e: e.bitwiseAND(_long((1 << high) - 1))
        entry = lambda rank, low: F.shiftleft(rank, high).bitwiseOR(low)

        def byte(b: Column, i: Column) -> Column:
            rank = F.coalesce(F.get(t["first"], b.cast("int") * 256 + F.get(word, i + 1)), _long(_NO_RANK))
            return entry(rank, F.shiftleft((i + 1).cast("long"), _ID).bitwiseOR(F.get(t["bytes"], b)))

        def join(s: Column, least: Column, at: Column) -> Column:
            new, before, behind = F.shiftright(least, high), F.get(s, at - 2), F.get(s, at + 1)
            joined = F.array(
                entry(self._rank(t, id_of(before), new), low_of(before)),
                entry(self._rank(t, new, id_of(behind)), least.bitwiseAND(_long(((1 << _PLACE) - 1) << _ID)).bitwiseOR(new)),
            )
            return F.flatten(F.array(F.slice(s, F.lit(1), at - 2), joined, F.slice(s, at + 2, F.lit(1 << 30))))

        def step(s: Column, _: Column) -> Column:
            place = lambda least: F.size(F.filter(s, lambda e: low_of(e) < low_of(least))) + 1
            done = lambda least: least >= _long(_NO_RANK << high)
            return _bound(F.array_min(s), lambda m: F.when(done(m), s).otherwise(_bound(place(m), lambda at: join(s, m, at))))

        ids = lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda e: id_of(e).cast("int"))
        return F.aggregate(F.sequence(F.lit(2), F.size(word)), F.concat(edge(0), F.transform(word, byte), edge((1 << _PLACE) - 1)), step, ids)

    def folded(self, words: Column) -> Column:
        """Ids (array<array<int>>) of words given as their bytes (array<array<smallint>>)."""
        return _bound(self._tables, lambda t: F.transform(words, lambda word: self._fold(t, word)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As the fold, for a word of any length: linked pieces and a heap of their neighbours' ranks, O(n log n)."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, last = heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != last:
            continue  # one of the two was joined to something else
        alive[j], end[i] = False, last
        if last < n:
            before[last] = i
        for a in (before[i], i):
            if a >= 0 and end[a] < n and (r := ranks.get(word[a : (b := end[end[a]])])) is not None:
                heappush(heap, (r, a, b))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Numbers(dict):
    """Numbers of words, for one task: a vocabulary word's rank, and for others, from ``first`` on, by their first use.

    Words of over ``fold_bytes`` bytes are not numbered: they give their ids, as a list.
    """

    def __init__(self, ranks: dict[bytes, int], fold_bytes: int):
        self.ranks, self.fold_bytes, self.first = ranks, fold_bytes, max(ranks.values(), default=-1) + 1
        for piece, rank in ranks.items():
            try:
                self[piece.decode()] = rank
            except UnicodeDecodeError:  # never a whole word
                pass
        self.next, self.fresh, self.long = self.first, [], False

    def forget(self, keep: int) -> None:
        """Only the first ``keep`` words stay, beside the vocabulary: what occurs early occurs often."""
        self.next = self.first + keep
        kept = {word: number for word, number in self.items() if number < self.next}
        self.clear()
        self.update(kept)

    def __missing__(self, word: str) -> int | list[int]:
        data = word.encode()
        if len(data) > self.fold_bytes:
            self.long = True
            return merge_long(data, self.ranks)
        number = self[word] = self.next
        self.next += 1
        self.fresh.append(data)
        return number


def joined_pieces(ids: np.ndarray, pieces: list[bytes], at_once: int = 1 << 18) -> bytes:
    """Bytes that ids stand for: their binary pieces, one after the other."""
    return b"".join(b"".join(map(pieces.__getitem__, ids[at : at + at_once].tolist())) for at in range(0, len(ids), at_once))


def _piece_list(ranks: dict[bytes, int]) -> list[bytes]:
    by_rank = {rank: piece for piece, rank in ranks.items()}
    return [by_rank.get(i, b"") for i in range(max(by_rank, default=-1) + 1)]


def decode_documents(tokens: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(``id_col``, decoded: binary): the bytes that each row's ids stand for. No ids, or null: no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _piece_list(ranks)
        for batch in batches:
            values, offsets = list_parts(batch.column("tokens"))
            ids = values.to_numpy(zero_copy_only=False)
            out = [joined_pieces(ids[a:b], pieces) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "decoded"])

    id_type = tokens.schema[id_col].dataType.simpleString()
    none = F.array().cast("array<int>")
    rows = tokens.select(F.col(id_col).alias("id"), F.coalesce(F.col(tokens_col).cast("array<int>"), none).alias("tokens"))
    return rows.mapInArrow(decode, f"id {id_type}, decoded binary").withColumnRenamed("id", id_col)


def _coded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, dictionary_words: int, fold_bytes: int, decode: bool) -> DataFrame:
    """(id, tokens: array<int>, and, if asked, decoded: binary), a row for each row of ``docs``.

    Three steps in a task, none of which shuffles: words are found and numbered, and a row brings the bytes of those that no row before it
    has; Spark folds these; and with the ids of all words so far, numbers become ids. Rows keep their order within a task, so
    the last step has folded words before they are used. ``epoch`` counts how often later words were forgotten.
    """
    if not 0 <= fold_bytes <= _EDGE_PLACE:
        raise ValueError(f"fold_bytes is {_EDGE_PLACE} at most: a piece's place in its word has {_PLACE} bits")
    text_batches(docs.sparkSession, 2)
    id_type = docs.schema[id_col].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, numbers, epoch = regex.compile(pattern).findall, _Numbers(ranks, fold_bytes), 0
        for batch in batches:
            codes, ends, words, word_ends, epochs = array("i"), [0], [], [0], []
            for text in batch.column("text"):
                if numbers.next - numbers.first > dictionary_words:
                    numbers.forget(dictionary_words // 2)
                    epoch += 1
                found = list(map(numbers.__getitem__, find(text.as_py() or "")))
                if numbers.long:
                    found, numbers.long = [x for f in found for x in (f if isinstance(f, list) else (f,))], False
                codes.extend(found)
                words += numbers.fresh
                numbers.fresh.clear()
                ends.append(len(codes))
                word_ends.append(len(words))
                epochs.append(epoch)
            data = pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int16))
            fresh = lists(word_ends, lists(np.cumsum([0, *map(len, words)]), data))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(ends, pa.array(np.array(codes, np.int32))), fresh, pa.array(epochs, pa.int32())], ["id", "codes", "fresh", "epoch"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, epoch, pieces = NumberedIds(max(ranks.values(), default=-1) + 1), 0, _piece_list(ranks) if decode else []
        for batch in batches:
            epochs = batch.column("epoch").to_numpy()
            codes, code_ends = list_parts(batch.column("codes"))
            folded, word_ends = list_parts(batch.column("folded"))
            values, id_ends = list_parts(folded)
            codes, values = codes.to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False)
            out, ends, at = [], [np.zeros(1, np.int64)], 0
            for last in [*(np.flatnonzero(np.diff(epochs)) + 1).tolist(), len(epochs)]:
                if last == at:
                    continue
                if epochs[at] != epoch:
                    known.forget(known.first + dictionary_words // 2)
                    epoch = epochs[at]
                a, b = word_ends[at], word_ends[last]
                known.add(values[id_ends[a] : id_ends[b]], np.diff(id_ends[a : b + 1]))
                ids, upto = known.of(codes[code_ends[at] : code_ends[last]])
                of_rows = code_ends[at + 1 : last + 1] - code_ends[at]
                ends.append(ends[-1][-1] + np.concatenate([[0], upto])[of_rows])
                out.append(ids)
                at = last
            ids, ends = np.concatenate([np.zeros(0, np.int32), *out]), np.concatenate(ends)
            columns = {"id": batch.column("id"), "tokens": lists(ends, pa.array(ids))}
            if decode:
                columns["decoded"] = pa.array([joined_pieces(ids[a:b], pieces) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    numbered = rows.mapInArrow(number, f"id {id_type}, codes array<int>, fresh array<array<smallint>>, epoch int")
    folded = numbered.select("id", "codes", "epoch", Merges(ranks).folded(F.col("fresh")).alias("folded"))
    return folded.mapInArrow(look_up, f"id {id_type}, tokens array<int>" + (", decoded binary" if decode else ""))


def encode_documents(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", *, dictionary_words: int = 1 << 20, fold_bytes: int = 256
) -> DataFrame:
    """One row for each row of ``docs``: (``id_col``, ids: string, the decimal ids joined by one space; tokens: the same as array<int>).

    Each match of ``pattern`` is encoded on its own, without special tokens. A word of the vocabulary is its rank. Each
    task folds its distinct words once, whatever the number of their occurrences, and remembers up to about ``dictionary_words``
    of them before it forgets the later half, which bounds its memory and changes no result. Nothing is shuffled, broadcast or collected.
    Words of over ``fold_bytes`` bytes, for which a fold's O(n^2) is too much, are merged by a heap instead (``merge_long``).

    Null and empty texts have no ids (an empty string). Repeated rows, and null ids of documents,
    keep a row each; other columns are not read. An empty input gives an empty result.
    """
    coded = _coded(docs, ranks, pattern, id_col, text_col, dictionary_words, fold_bytes, False)
    return coded.select(F.col("id").alias(id_col), _joined("tokens"), "tokens")


def _joined(tokens: str) -> Column:
    return F.array_join(F.col(tokens).cast("array<string>"), " ").alias("ids")


def encode_and_decode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", *, dictionary_words: int = 1 << 20, fold_bytes: int = 256
) -> DataFrame:
    """``encode_documents``, and back from the ids: (``id_col``, ids: string, n_tokens: long, decoded: binary, tokens: array<int>); nulls and empty texts alike."""
    coded = _coded(docs, ranks, pattern, id_col, text_col, dictionary_words, fold_bytes, True)
    return coded.select(F.col("id").alias(id_col), _joined("tokens"), F.size("tokens").cast("long").alias("n_tokens"), "decoded", "tokens")
