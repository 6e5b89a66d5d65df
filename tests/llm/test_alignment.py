"""Alignment of tokenizers against loops, with their own libraries."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm.alignment import ByteLevel, Pieces, Vocabularies, _byte_alphabet, _digest, _is_plain, align

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", "the cat sat on the mat, and the cat's hat", "the dog <|endoftext|> </s> <s> <unk>", "naïve café 𝄞𝄞 日本語の文章です кириллица", "\n\n\t x\r\n y ", "12345 67,890.12 !!! ???",
    "the cat sat on the mat, and the cat's hat", "a▁b ▁▁", "\x00\x01 � ​", "é é", "=" * 3000, "abcdefgh" * 400, "supercalifragilistic " * 50, "<0x41> A", "ﬁne ① ½",
]


def _brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    library.encode_special_tokens = True
    byte = _byte_alphabet()
    a_bytes = lambda i: bytes(byte[c] for c in library.id_to_token(i))
    b_bytes = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    rows = []
    for text in texts:
        a, b = (library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        groups, x, y = [], 0, 0
        group, at, bt = ([], []), 0, 0
        while x < len(a) or y < len(b):
            if at <= bt:
                at += len(a_bytes(a[x]))
                group[0].append(a[x])
                x += 1
            else:
                bt += len(b_bytes(b[y]))
                group[1].append(b[y])
                y += 1
            if at == bt and group[1]:
                groups.append(group)
                group = ([], [])
        rows.append((a, b, groups, Counter((i, j) for g in groups for i in g[0] for j in g[1])))
    counts = Counter(p for *_, links in rows for p in links)
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for a, b, groups, links in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), links.total(), sum(m for p, m in links.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("pattern, options", [(public_tokenizers.PATTERN, {}), (None, {"crowd": 2, "frequent": 7}), (public_tokenizers.PATTERN, {"crowd": 1, "frequent": 10**9})])
def test_as_a_loop_aligns_them(spark, pattern, options):
    texts = TEXTS + TEXTS[4:6]
    frame = spark.createDataFrame([(i if i != 5 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, pair string, row int").repartition(3)
    out = align(frame, ByteLevel(FIRST, pattern), Pieces(SECOND), **options).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out)
    assert found == sorted((i if i != 5 else -1, *row) for i, row in enumerate(_brute(texts)))
    assert align(frame.where("doc_id < 0"), ByteLevel(FIRST, pattern), Pieces(SECOND), **options).count() == 0


def test_texts_that_do_not_come_back_have_no_tokens(spark, tmp_path):
    file = json.load(open(FIRST, encoding="utf-8")) | {"normalizer": {"type": "Lowercase"}}
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    out = align(spark.createDataFrame([(1, "Upper"), (2, "lower")], "doc_id long, text string"), ByteLevel(str(path), public_tokenizers.PATTERN), Pieces(SECOND)).collect()
    assert {r.doc_id: (r.n_a > 0, r.n_b > 0, r.groups_sha256 != "") for r in out} == {1: (False,) * 3, 2: (True,) * 3}


def test_a_long_text(spark):
    frame = spark.createDataFrame([("long", "the quick brown fox " * 60_000 + "é" * 100_000)], "name string, body string")
    row = align(frame, ByteLevel(FIRST, public_tokenizers.PATTERN), Pieces(SECOND), "name", "body").first()
    assert row.n_a > 240_000 and row.n_groups > 240_000 and row.n_best > 0


def test_only_plain_files_are_taken_for_ranks():
    file = json.load(open(FIRST, encoding="utf-8"))
    assert _is_plain(file)
    assert not _is_plain(file | {"normalizer": {"type": "NFC"}}) and not _is_plain(file | {"pre_tokenizer": None})
    assert not _is_plain(file | {"model": file["model"] | {"merges": file["model"]["merges"][1:]}})


def test_frequent_pairs_are_bounded_and_others_not_lost(spark):
    frame = spark.createDataFrame([(i, f"token {i} and word {i * 7}") for i in range(40)], "doc_id long, text string")
    plain = align(frame, ByteLevel(FIRST, public_tokenizers.PATTERN), Pieces(SECOND))
    few = align(frame, ByteLevel(FIRST, public_tokenizers.PATTERN), Pieces(SECOND), frequent=2)
    assert plain.exceptAll(few).count() == 0 and plain.where(F.col("n_links") > 0).count() == 40


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_rows_of_a_batch_are_digested_as_each_alone(crowd):
    coders = ByteLevel(FIRST, public_tokenizers.PATTERN).load(), Pieces(SECOND).load()
    known = Vocabularies.of((coders[0].pieces, coders[1].pieces))
    texts = [t for t in TEXTS if not t or "▁" not in t]  # whose tokens join to just them
    rows = [[np.array(coder.ids(before + t) if t else [], np.int64) for t in texts] for coder, before in zip(coders, (" ", ""))]
    columns = lambda found: list(zip(*(c.to_pylist() for c in found)))
    alone = [columns(_digest([a], [b], known, crowd, pa.int64()))[0] for a, b in zip(*rows)]
    assert columns(_digest(*rows, known, crowd, pa.int64())) == alone
    assert columns(_digest([], [], known, crowd, pa.int32())) == []
    kept = lambda r: sum(len(g["a"]) * len(g["b"]) for g in r[7])
    assert all(sum(r[6]) + kept(r) == r[3] and r[5] == sorted(set(r[5])) for r in alone)


def test_groups_are_not_made_by_interpreted_lambdas(spark):
    frame = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    staged = []
    from tessera.llm import alignment

    keep, alignment.staged = alignment.staged, lambda df, name, **options: staged.append(df) or keep(df, name, **options)
    try:
        align(frame, ByteLevel(FIRST, public_tokenizers.PATTERN), Pieces(SECOND))
    finally:
        alignment.staged = keep
    assert "lambda" not in staged[0]._jdf.queryExecution().executedPlan().toString()
