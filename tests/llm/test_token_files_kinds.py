"""Tokenizer files of other kinds go through the library; very long texts have the library's ids."""

import gc
import json

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "Hello  World's 123 naïve CAFÉ\n\tÅngström é <|endoftext|> x", "日本語 \x1c a", "ﬁ Straße İstanbul"]


def test_kinds_of_files(tmp_path):
    file = json.load(open(PATH, encoding="utf-8"))
    assert token_files.goes_by_words(file)
    others = (
        file | {"normalizer": None}, file | {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}, *file["normalizer"]["normalizers"][1:]]}},
        file | {"pre_tokenizer": {"type": "Whitespace"}}, file | {"added_tokens": [file["added_tokens"][0] | {"content": "the", "special": False}]},
    )
    for k, other in enumerate(others):
        assert not token_files.goes_by_words(other)
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(other), encoding="utf-8")
        token_files.worker_encoder.cache_clear()
        ids, ends = token_files.worker_encoder(str(path)).encode_flat(TEXTS)
        library = Tokenizer.from_file(str(path))
        expected = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == expected
    token_files.worker_encoder.cache_clear()


def test_a_long_text_has_the_librarys_ids():
    text = " ".join(f"Word{i % 977} naïve, {i} don't Å{i % 13}é" for i in range(130_000))
    assert len(text) > 3_500_000
    ids, ends = token_files.WordEncoder(PATH).encode_flat([text, None, "x" * 300_000])
    library = Tokenizer.from_file(PATH)
    assert ids[: ends[0]].tolist() == library.encode(text, add_special_tokens=False).ids and ends[1] == ends[0]
    assert ids[ends[1] :].tolist() == library.encode("x" * 300_000, add_special_tokens=False).ids


def test_known_words_are_not_searched_for_cycles():
    encoder, searches = token_files.WordEncoder(PATH), []
    texts = [" ".join(f"wörd{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} Mixed{i}, x{i}" for i in range(k, 20_000, 7)) for k in range(7)]
    seen = lambda phase, _: searches.append(phase)
    gc.collect()
    gc.callbacks.append(seen)
    try:
        ids, ends = encoder.encode_flat(texts)
    finally:
        gc.callbacks.remove(seen)
    assert len(searches) <= 4 and gc.isenabled()  # it may begin when it may again
    library = Tokenizer.from_file(PATH)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
