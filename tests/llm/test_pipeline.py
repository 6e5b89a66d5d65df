"""The pipeline's stages, each against brute force on its own input, and run() against the stages."""

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import bpe, mixing, quality_stats
from tessera.llm.shared import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test")
        out.append(docs.toPandas())
    return out


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_columns_and_names(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing", "byte-level bpe"]
    assert all(tuple(s.columns) == corpus_pipeline.COLUMNS for s in steps[1:-1])


def test_rules_reject_what_fails_and_keep_texts(steps):
    before, after = steps[0].set_index("doc_id"), steps[1].set_index("doc_id")
    for i, text in before.text.items():
        n, _, _, _, repeated = quality_stats.document_stats(text)[:5]
        assert not ((n < 10 or 100 * repeated > 20 * n) and i in after.index)
    assert (after.text == before.text[after.index]).all() and 0.5 < len(after) / len(before) < 1


def test_lines_that_sources_share_stay_once(steps):
    sites, first = {}, {}
    for r in steps[1].itertuples():
        for line in r.text.split("\n"):
            if line.encode().split():
                sites.setdefault(line, set()).add(r.source)
                first[line] = min(first.get(line, r.doc_id), r.doc_id)
    flagged = {line for line, s in sites.items() if len(s) >= (3 if len(line.encode().split()) >= 5 else 6)}
    expected = {r.doc_id: "\n".join(x for x in r.text.split("\n") if x not in flagged or first[x] == r.doc_id) for r in steps[1].itertuples()}
    before = dict(zip(steps[1].doc_id, steps[1].text))
    expected = {i: t for i, t in expected.items() if t.split() or not before[i].split()}
    assert dict(zip(steps[2].doc_id, steps[2].text)) == expected


def test_one_of_each_group_of_copies_stays(steps):
    before, kept = {r.doc_id: shingles(r.text) for r in steps[2].itertuples()}, set(steps[3].doc_id)
    near = lambda a, b, least: len(a & b) >= least * len(a | b)
    for i, a in before.items():
        partners = [j for j, b in before.items() if j != i and a and near(a, b, 0.7)]
        assert i in kept or partners  # nothing else is removed
        assert not any(near(a, before[j], 1.0) for j in partners if i in kept and j in kept)
    pairs = [(i, j) for i in kept for j in kept if i < j and before[i] and near(before[i], before[j], 0.85)]
    assert len(pairs) <= 0.05 * len(kept)


def test_mix_takes_its_targets(steps):
    docs, taken = steps[3], steps[4]
    sizes = docs.text.map(lambda t: len(t.encode().split())).groupby(docs.source).sum()
    order = sorted(sizes.index)
    aims = dict(zip(order, mixing.targets([int(sizes[s]) for s in order], mixing.Mix())))
    got = taken.text.map(lambda t: len(t.encode().split())).groupby(taken.source).sum()
    assert all(abs(got.get(s, 0) - aims[s]) <= 64 for s in order)
    texts = dict(zip(docs.doc_id, docs.text))
    assert all(t.strip() in texts[i] for i, t in zip(taken.doc_id, taken.text))


def test_ids_as_the_library(steps):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    expected = sorted((i, library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(steps[4].doc_id, steps[4].text))
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in steps[5].itertuples()) == expected


def test_run_is_the_stages(spark, steps):
    out = corpus_pipeline.run(spark, SF).toPandas()
    key = lambda frame: sorted(zip(frame.doc_id, frame.n_tokens, frame.decoded_sha256))
    assert key(out) == key(steps[-1])
