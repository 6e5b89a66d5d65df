"""Operators against brute force on a small fixture with nulls, blanks, copies, repeated rows, and clashing column names."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, components, crf, gbt, labelled, line_dedup, mixing, nbsvm, quality_rules, quality_stats, sharding, simhash, token_files, toxicity

BASE = [f"the quick brown fox number {i} jumps over {i * i} lazy dogs near the old stone bridge at dawn" for i in range(12)]
TEXTS = [
    *BASE, BASE[0], BASE[0].upper(), BASE[1] + " today", None, "", " \t\n", "Été À la Straße 漢字 don't 12.5!!", "a", "x" * 300, "\n".join([BASE[2], BASE[3], BASE[2]]),
    "boiler plate line with seven words here\n" + BASE[4], "boiler plate line with seven words here\n" + BASE[5], "boiler plate line with seven words here\n" + BASE[6],
]
ROWS = [(i, t, "en", f"s{i % 4}" if i % 7 else None) for i, t in enumerate(TEXTS)] + [(3, BASE[3], "en", "s3"), (None, BASE[7], None, "s1")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = {c: F.lit(c) for c in ("fp", "id", "key", "size", "shard", "slot", "words", "start", "score", "_lose", "known")}
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns(extra).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")  # on data, so Spark cannot fold it away: partitions without rows


def words(text):
    return (text or "").encode().split()


def fingerprint(text, k):
    w = [x.lower() for x in words(text)]
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_by_brute_force(docs, empty):
    out = simhash.near_duplicates(docs, shingle_words=3, max_distance=2).collect()
    prints = [(i, fingerprint(t, 3)) for i, t, *_ in ROWS]
    group = list(range(len(prints)))
    for _ in group:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((p[0] for p, h in zip(prints, group) if h == g and p[0] is not None), default=None) for g in group}
    expected = sorted(((i, f"{f:016x}", least[g]) for (i, f), g in zip(prints, group)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=repr) == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 2**62))
    prints = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (120, 2))} | {int(x) for x in rng.integers(0, 2**62, 40)}
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    assert len(simhash.block_masks(2, 4)) == 6
    parts = components.connected_components(simhash.hamming_links(frame, 2, 4, bucket_cap=4)).collect()
    of, root = {p: p for p in prints}, {r.node: r.root for r in parts}
    for _ in range(8):
        for a in prints:
            of[a] = min(of[b] for b in prints if (a ^ b).bit_count() <= 2)
    pairs = [(a, b) for a in prints for b in prints if a < b]
    assert all((of[a] == of[b]) == (root.get(a, a) == root.get(b, b)) for a, b in pairs)


def test_crowded_buckets_verify_every_pair_at_six_bits(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    # 300 fingerprints that agree in 3 of 9 blocks only: one bucket, of which pairs differ in 6 other blocks
    prints = {base ^ sum(1 << int(b) for b in rng.choice(np.arange(22, 62), 5, replace=False)) for _ in range(300)}
    links = simhash.hamming_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 6, 9, bucket_cap=8).collect()
    expected = sorted((a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 6)
    assert len(expected) > 100 and sorted((r.u, r.v) for r in links) == expected


def test_near_copies_leave_one(docs, empty):
    kept = [r.doc_id for r in simhash.drop_near_copies(docs).collect()]
    assert 0 in kept and 12 not in kept and 13 not in kept and 14 not in kept and 1 in kept
    assert {15, 16, 17} <= set(kept) and None in kept and kept.count(3) == 2
    assert simhash.drop_near_copies(empty).count() == 0


def test_near_copies_far_in_fingerprints_or_near_the_limit(spark):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(40):
        w = [f"w{x}" for x in rng.integers(0, 4000, 400)]
        texts.append(w)
        texts.append(w[: int(rng.integers(300, 345))])  # similarities around 0.8
        texts.append(w + [w[5]] * 3 + [f"v{x}" for x in rng.integers(0, 4000, 70)])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    group = list(range(len(sets)))
    links = [(a, b) for a in group for b in group if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(3):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(frame).collect())
    assert kept == sorted(set(group)) and 40 < len(kept) < 120


def test_components_of_a_chain_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (100, 101)], "u long, v long")
    out = {r.node: r.root for r in components.connected_components(chain).collect()}
    assert len({out[i] for i in range(41)}) == 1 and out[100] == out[101] and 7 in out
    assert components.connected_components(chain.where("u < 0")).count() == 0


def test_bpe_as_the_library(docs, empty):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for size in (1 << 19, 3):  # the dictionary holds all, or almost none
        out = bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN, dictionary_words=size).collect()
        expected = sorted((i if i is not None else -1, " ".join(map(str, library.encode_ordinary(t or ""))), (t or "").encode()) for i, t, *_ in ROWS)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids, bytes(r.decoded)) for r in out) == expected
        assert all(r.n_tokens == len(r.ids.split()) for r in out)
    assert bpe.encode_and_decode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((240, 8))
    x[200:] = x[7]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0]), (304, [None] * 8), (None, [1.0] * 8), (5, x[5].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))
    index = ann.Index(tables=8, hashes=4, probes=24, part_rows=50)
    out = ann.nearest(frame, F.col("vec_id") % 20 == 0, k=20, index=index).toPandas()
    hits = 0
    for q in range(0, 240, 20):
        mine = out[out.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine.vec_id)
        scores = x @ x[q]
        assert np.allclose(mine.score, scores[mine.vec_id])
        best = sorted((i for i in range(240) if i != q), key=lambda i: (-round(scores[i], 9), i))[:20]
        hits += len(set(best) & set(mine.vec_id))
    assert hits >= 0.9 * 240
    tiles = ann.nearest(frame, F.col("vec_id") % 20 == 0, k=20, index=ann.Index(tables=8, hashes=4, probes=24, part_rows=2)).toPandas()  # shares of 8 points and 8 queries
    order = ["query_id", "rank"]
    tiles, whole = tiles.sort_values(order), out.sort_values(order)
    assert tiles[[*order, "vec_id"]].values.tolist() == whole[[*order, "vec_id"]].values.tolist() and np.allclose(tiles.score, whole.score, rtol=1e-12)
    few = ann.nearest(frame.where("vec_id < 5"), F.col("vec_id") == 0, k=20, index=index)
    assert few.count() == 4  # all candidates, if fewer
    assert ann.nearest(frame.where("vec_id < 0"), F.lit(True)).count() == 0


def test_repeated_rows_of_one_id_leave_room_for_others(spark):
    x = np.random.default_rng(4).standard_normal((60, 8))
    x[8:41] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 30
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), k=20, index=ann.Index(tables=8, hashes=4, probes=24, part_rows=50)).where("query_id = 7").collect()
    scores = x @ x[7]
    best = sorted((i for i in range(60) if i != 7), key=lambda i: (-round(scores[i], 9), i))[:20]
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"])] == best


def test_token_files_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, at, expected = Tokenizer.from_file(path), 0, []
    rows = [*ROWS, (900, "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>", None, None), (901, "Stop. stop, STOP!! don't " * 3, None, None)]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(rows[-2:], SCHEMA), allowMissingColumns=True)
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0], xxhash.xxh64_intdigest((r[1] or "").encode(), 42))):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    out = [tuple(r) for r in token_files.tokenize_to_files(docs, path, 2).orderBy("start").collect()]
    assert sorted(out, key=repr) == sorted(expected, key=repr)
    assert token_files.tokenize_to_files(empty, path, 2).count() == 0


def test_word_encoder_forgets_and_stays_right():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), token_files.WordEncoder(path, remember=5, keep=3)
    texts = [t or "" for t in TEXTS] + ["a\x1cb c d", "<|endoftext|> İΣ ǅ é", "...!!", "µ ß ª º ÀÉ À́ é ŉ ſ İ ǰ 12.5% don't... ###a##b 'S 'tis ñ\xa0o Ÿ Ω É.É, it's-It'S", "x\x1cy É"]
    for _ in range(2):
        assert encoder.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_document_stats_by_loops():
    rng = np.random.default_rng(5)
    for _ in range(60):
        text = "".join(rng.choice(["a ", "b ", "c\n", "# ", "\n"], rng.integers(0, 60)))
        w = text.split()
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.strip()]
        stats = quality_stats.document_stats(text)
        assert stats[:5] == (len(w), sum(map(len, w)), text.count("#"), len(lines) - len(set(lines)), len(covered))
    assert quality_stats.document_stats(None)[:5] == (0,) * 5
    assert quality_stats.document_stats("é é ü")[1] == 3


def test_trees_keep_their_constraints():
    rng = np.random.default_rng(6)
    x = rng.random((600, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(600) < 0.2)).astype(float)
    trees = gbt.fit_trees(x, y, (-1, 1, 0))
    line = np.linspace(0, 1, 50)
    for row in x[:20]:
        for f, sign in ((0, -1), (1, 1)):
            probe = np.tile(row, (50, 1))
            probe[:, f] = line
            assert (np.diff(trees.margin(probe)) * sign >= -1e-12).all()
    assert ((trees.probability(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.9
    assert np.allclose(gbt.fit_trees(x, np.ones(600), (0, 0, 0)).probability(x), 600.5 / 601)


def test_quality_rules_and_edges(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = quality_rules.assess(docs, labels).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed)
    assert quality_rules.keep_good(docs, labels).columns == docs.columns
    assert quality_rules.assess(empty, labels.where("doc_id < 0")).count() == 0


def test_boilerplate_by_loops(docs, empty):
    rule = line_dedup.Boilerplate()
    where, first = {}, {}
    for i, t, _, s in ROWS:
        for line in set((t or "").split("\n")):
            if line.split():
                where.setdefault(line, set()).update({s} - {None})
                if i is not None:
                    first[line] = min(first.get(line, i), i)
    flagged = {line for line, sites in where.items() if len(sites) >= (rule.least_sites if len(line.split()) >= rule.short_words else rule.short_sites)}
    assert flagged
    expected = sorted((repr(i), repr(t if t is None else "\n".join(x for x in t.split("\n") if x not in flagged or first[x] == i))) for i, t, *_ in ROWS)
    out = line_dedup.remove_boilerplate(docs)
    assert out.columns == [*docs.columns, "removed_lines"]
    assert sorted((repr(r.doc_id), repr(r.text)) for r in out.collect()) == expected
    assert line_dedup.remove_boilerplate(empty).count() == 0


def test_sharding_moves_into_the_new_shard_only(docs, empty):
    out = sharding.assign_shards(docs).collect()
    assert len(out) == len(ROWS)
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    assert all(r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 for r in out)
    assert sorted((r["size"], r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)
    assert sharding.assign_shards(empty).count() == 0


def test_tree_follows_weights_and_confines_moves(spark):
    rows = spark.range(4000)
    tree = sharding.Tree(((((0, 3.0), (1, 1.0)),), (((2, 4.0),),)))
    lighter = sharding.Tree(((((0, 3.0), (1, 1.0)),), (((2, 2.0),),)))
    out = rows.select(tree.shard_of(F.col("id")).alias("a"), lighter.shard_of(F.col("id")).alias("b")).toPandas()
    share = out["a"].value_counts(normalize=True)
    assert abs(share[0] - 0.375) < 0.04 and abs(share[2] - 0.5) < 0.04
    moved = out[out["a"] != out["b"]]
    assert len(moved) and set(moved["a"]) == {2}


def test_mix_by_its_pieces(docs, empty):
    mix = mixing.Mix(block_words=4, blocks_a_shard=8)
    report = mixing.mix_report(docs, mix).collect()
    assert len(report) == len(ROWS)
    assert sorted(r["size"] for r in report) == sorted(len(words(t)) for _, t, *_ in ROWS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in report)
    sizes = {}
    for _, t, _, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = mixing.targets([sizes[s] for s in order], mix)
    assert sum(aims) == pytest.approx(1.5 * sum(sizes.values()))
    assert {(r.source_size, r.target) for r in report} == {(sizes[s], aim) for s, aim in zip(order, aims)}
    assert abs(sum(r.taken for r in report) - sum(aims)) <= 2 * mix.block_words * len(aims)
    pieces = mixing.mix_sources(docs, mix).collect()
    assert sum(p.words for p in pieces) == sum(r.taken for r in report) and all(len(words(p.text)) == p.words for p in pieces)
    assert sorted(map(repr, mixing.mix_report(docs, mix).collect())) == sorted(map(repr, report))
    assert mixing.mix_report(empty, mix).count() == 0 and mixing.mix_sources(empty, mix).count() == 0


def test_targets_and_permutations():
    assert mixing.targets([100, 10, 1000], mixing.Mix()) == pytest.approx([200, 20, 1445])
    assert mixing.targets([], mixing.Mix()) == [] and mixing.targets([0, 0], mixing.Mix()) == [0, 0]
    for n in (1, 2, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    slots = np.array([50, 3, 0, 17])
    parts = [mixing.shard_counts(slots, 9, k, 1, {}) for k in range(9)]
    assert (sum(c for c, _ in parts) == slots).all()
    assert all((parts[k][1] == sum((c for c, _ in parts[:k]), np.zeros(4, int))).all() for k in range(9))


def test_hinge_loss_is_minimised():
    rng = np.random.default_rng(8)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(80)]
    y = np.array([float(0 in r or 1 in r) for r in rows])
    scale = np.ones(32)
    w, bias = nbsvm.dual_coordinate_descent(rows, scale, y, cost=1.0, epochs=300)
    share = np.array([np.mean(y == 0), np.mean(y > 0)])

    def loss(w, bias):
        margin = np.array([w[r].sum() + bias for r in rows]) * np.where(y > 0, 1, -1)
        return (w @ w + bias**2) / 2 + (np.maximum(0, 1 - margin) / (2 * share[y.astype(int)])).sum()

    best = loss(w, bias)
    assert all(best <= loss(w + d * 0.02, bias + e * 0.02) + 1e-2 for d, e in ((rng.standard_normal(32), rng.standard_normal()) for _ in range(50)))
    assert nbsvm.fit([], np.zeros(0), 4).score(np.zeros(0, np.int64)) == 0.5


def test_classifiers_on_tables(spark, docs, empty):
    sf = "/root/testdata/sf0.001"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = nbsvm.classify_quality(documents, labels).join(labels, "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert (out.predicted == out.quality)[~out.held_out].mean() > 0.9 and out.score.between(0, 1).all()
    tox = toxicity.score_toxicity(documents, labels).join(labels, "doc_id").toPandas()
    assert (tox.predicted == tox.toxic).mean() > 0.7 and tox.score.between(0, 1).all()
    for f in (nbsvm.classify_quality, toxicity.score_toxicity):
        assert f(docs, labels).count() == len(ROWS)
        assert {r.score for r in f(docs, labels.where("doc_id < 0")).collect()} == {0.5}
        assert f(empty, labels).count() == 0


def test_marginals_by_enumeration():
    rng = np.random.default_rng(9)
    chain = crf.Chain(np.zeros(1), -0.7, 0.3, 1.1, 0)
    for n in (1, 2, 5):
        e = rng.standard_normal(n)
        total, tagged = 0.0, np.zeros(n)
        for code in range(2**n):
            s = [code >> i & 1 for i in range(n)]
            score = sum(e[i] * s[i] for i in range(n)) + sum({(0, 0): 0, (0, 1): chain.a, (1, 0): chain.b, (1, 1): chain.c}[p] for p in zip([0, *s], s))
            total += np.exp(score)
            tagged += np.exp(score) * np.array(s)
        assert np.allclose(1 / (1 + np.exp(-crf.marginals([e], chain)[0])), tagged / total)


def test_chain_learns_and_spans_have_offsets(spark):
    windows = [([b"you", b"bad" + str(i % 3).encode(), b"thing"], [0, 1, 0]) for i in range(60)] + [([b"a", b"nice", b"day"], [0, 0, 0])] * 60
    model = toxicity.Toxicity(crf.fit_chain(windows, 12), (0.0, 1.0, 0.0))
    frame = spark.createDataFrame([("é you bad1! thing",), (None,), ("nice day",)], "text string")
    spans = [r[0] for r in frame.select(toxicity.toxic_spans(model, F.col("text"))).collect()]
    assert [(s.start, s.end, s.text) for s in spans[0]] == [(6, 11, "bad1!")] and spans[1] == [] == spans[2]


def test_folds_and_samples(spark, docs):
    fold = spark.range(50).select("id", labelled.fold_of(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in fold)
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    assert [(r.doc_id, r.label) for r in labelled.labelled_sample(docs, labels, "quality", 10).collect()] == [(4, 1)]
    named = docs.select(F.col("doc_id").alias("n"), F.col("text").alias("words"), F.lit("x").alias("doc_id"), F.lit("y").alias("text"))
    assert [r.text for r in labelled.labelled_sample(named, labels, "quality", 10, None, "n", "words").collect()] == [BASE[4]]




def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    values, first, count = np.unique(np.asarray(score)[order], return_index=True, return_counts=True)
    rank[order] = np.repeat(first + (count - 1) / 2, count)
    ones = np.asarray(label) == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_documents_are_told_apart(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    quality = nbsvm.classify_quality(documents, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(quality) > 50 and auc(quality.score, quality.quality) > 0.95 and (quality.predicted == quality.quality).mean() > 0.9
    toxic = toxicity.score_toxicity(documents, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(toxic) > 50 and auc(toxic.score, toxic.toxic) > 0.9 and (toxic.predicted == toxic.toxic).mean() > 0.9
    assert toxic.spans.map(len)[toxic.predicted == 1].mean() > 0.5


def test_scores_by_loops(spark):
    """Scores of a fitted model, from the definition of its indicators and weights."""
    sf = "/root/testdata/sf0.001"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = nbsvm.fit_quality(documents, labels)
    out = documents.select("text", nbsvm.quality_score(model, F.col("text")).alias("score")).limit(40).collect()
    mask, mix = 2**64 - 1, 0x9E3779B97F4A7C15

    def shape(word):
        kinds = ["A" if 65 <= c <= 90 else "a" if 97 <= c <= 122 else "9" if 48 <= c <= 57 else "w" if c >= 128 else chr(c) for c in word]
        return b"\x00" + "".join(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k).encode()

    for r in out:
        w = words(r.text)
        found = set()
        for hashes in ([xxhash.xxh64_intdigest(x.lower(), 7) for x in w], [xxhash.xxh64_intdigest(shape(x), 7) for x in w]):
            found |= set(hashes) | {(a * mix + b) * mix & mask for a, b in zip(hashes, hashes[1:])}
        same = sum(a.lower() == b.lower() for a, b in zip(w, w[1:]))
        if w:
            found |= {(0xABCD + k) * mix & mask for k in range(1 + -(-10 * same // len(w)))}
        margin = sum(float(model.weight[i]) for i in {h >> (64 - model.bits) for h in found}) + model.bias
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30))), abs=1e-4)


def spark_hash(*values):
    """Spark's xxhash64 of longs and strings: each value's hash is the next one's seed, nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), h)
    return h - 2**64 if h >= 2**63 else h


def test_mix_replayed_by_loops(docs, spark):
    mix = mixing.Mix(block_words=4, blocks_a_shard=8, buckets=5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    reports = []
    for partitions in ("3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        reports.append(sorted(((r.doc_id, r["size"], r.taken) for r in mixing.mix_report(docs.repartition(int(partitions)), mix).collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    sources = sorted({s for *_, s in ROWS}, key=lambda s: (s is None, s or ""))
    rows = {s: sorted((spark_hash(i, spark_hash(t or ""), len(words(t))) % 5, i is not None, i or 0, spark_hash(t or ""), len(words(t))) for i, t, _, of in ROWS if of == s) for s in sources}
    sizes = [sum(r[-1] for r in rows[s]) for s in sources]
    aims, blocks = mixing.targets(sizes, mix), [-(-n // 4) for n in sizes]
    slots = np.array([round(a * b / n) if n else 0 for a, b, n in zip(aims, blocks, sizes)])
    shards, times = -(-int(slots.sum()) // 8), {}
    for shard in range(shards):
        counts, earlier = mixing.shard_counts(slots, shards, shard, mix.seed, {})
        for s in range(len(sources)):
            for index in range(int(earlier[s]), int(earlier[s] + counts[s])):
                turn, place = divmod(index, blocks[s])
                block = int(mixing.permuted(np.array([place]), blocks[s], (mix.seed << 40) + (s << 8) + turn)[0])
                times[s, block] = times.get((s, block), 0) + 1
    expected = []
    for s, source in enumerate(sources):
        start = 0
        for _, has_id, i, _, n in rows[source]:
            expected.append((i if has_id else None, n, sum(times.get((s, w // 4), 0) for w in range(start, start + n))))
            start += n
    assert reports[0] == reports[1] == sorted(expected, key=repr)


def test_draws_of_more_items_than_numpy_draws():
    counts = np.array([3 * 10**9, 10**9 + 7, 5, 0, 12 * 10**11])
    for left in (1, 10**9, 10**12 + 3, int(counts.sum()) - 1):
        taken = mixing._split(counts, left, (1, 2, 3))
        assert taken.sum() == left and (taken >= 0).all() and (taken <= counts).all()
    assert 0.4 < mixing._split(counts, int(counts.sum()) // 2, (4,))[4] / counts[4] < 0.6


def test_shards_by_loops(spark, docs):
    tree = sharding.Tree(((((0, 3.0), (1, 1.0)), ((2, 2.0),)), (((3, 4.0),),)))

    def pick(key, path, children):
        draws = [np.log(((spark_hash(key, "/".join(map(str, (*path, name)))) % 2**64 >> 12) + 0.5) / 2.0**52) / w for name, w in children]
        return int(np.argmax(draws)) if len(children) > 1 else 0

    def shard(key):
        r = pick(key, ("region",), [(i, sum(w for rack in region for _, w in rack)) for i, region in enumerate(tree.regions)])
        k = pick(key, ("rack", r), [(i, sum(w for _, w in rack)) for i, rack in enumerate(tree.regions[r])])
        return tree.regions[r][k][pick(key, ("shard", r, k), tree.regions[r][k])][0]

    out = spark.range(300).select("id", tree.shard_of(F.col("id")).alias("shard")).collect()
    assert [r.shard for r in out] == [shard(r.id) for r in out]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    other = sorted(map(repr, sharding.assign_shards(docs.repartition(5)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert other == sorted(map(repr, sharding.assign_shards(docs).collect()))


def test_short_lines_need_more_sites(spark):
    rows = [(i, f"All rights reserved.\nown words {i}\nsome longer line that stands on sites\nrare", f"s{i}") for i in range(6)] + [(9, "own\nrare", "s9")]
    out = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows[:5], "doc_id long, text string, source string")).collect()}
    assert out[4] == "All rights reserved.\nown words 4\nrare"
    out = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0] == rows[0][1] and out[5] == "own words 5" and out[9] == "own"


def test_copies_among_crowds(spark):
    """Passages that more texts share than a crowd, texts that are little else, and groups of copies, against all pairs."""
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passages, texts = [fresh(60) for _ in range(3)], []
    for p in passages:
        texts += [p + fresh(int(rng.integers(0, 30))) for _ in range(12)] + [fresh(200) + p + fresh(150) for _ in range(12)]
    base = fresh(300)
    for _ in range(25):
        copy = list(base)
        for at in rng.integers(0, 300, int(rng.integers(1, 9))):
            copy[at] = f"v{rng.integers(10**6)}"
        texts.append(copy)
    texts += [fresh(400)[:k] for k in (1, 3, 5, 6)] + [passages[0] + passages[1] + passages[2]] * 2
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    group = list(range(len(sets)))
    links = [(a, b) for a in group for b in group if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(30):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for crowd in (2, 5, 64):
        assert sorted(r.doc_id for r in simhash.drop_near_copies(frame, crowd=crowd, pairs_side=4).collect()) == sorted(set(group))


def test_only_vocabulary_words_and_empty_partitions(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    one = spark.createDataFrame([(1, "the")], "doc_id long, text string").repartition(4)
    assert [(r.ids, bytes(r.decoded), r.tokens) for r in bpe.encode_and_decode(one, ranks, public_tokenizers.PATTERN).collect()] == [("1169", b"the", [1169])]
    assert bpe.encode_and_decode(one.where("doc_id < 0"), ranks, public_tokenizers.PATTERN).count() == 0
    assert bpe.decode_documents(one.select("doc_id", F.array(F.lit(1169), F.lit(262)).alias("tokens")), ranks).first().decoded == b"the the"


def test_long_words_are_merged_as_short_ones():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(13)
    for n in (1, 2, 3, 50, 3000):
        word = "".join(rng.choice(list("abcdeéh漢"), n))
        assert bpe.merge_long(word.encode(), ranks) == (library.encode_ordinary(word) if word.encode() not in ranks else [ranks[word.encode()]])


def test_texts_of_many_megabytes(spark):
    """One text of 4 MB with every operator that reads whole texts, beside short ones."""
    rng = np.random.default_rng(14)
    many = " ".join(f"w{x}" for x in rng.integers(0, 200_000, 600_000))
    frame = spark.createDataFrame([(1, many, "a"), (2, "x" * 1_000_000, "b"), (3, "a short text of a few words", "a"), (4, many + " more", "c")], "doc_id long, text string, source string").repartition(2)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(frame).collect()}
    assert (prints[1] ^ prints[4]).bit_count() <= 2 and prints[2] == fingerprint("x" * 1_000_000, 3)
    assert [r.doc_id for r in simhash.drop_near_copies(frame).orderBy("doc_id").collect()] == [1, 2, 3]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = {1: many, 2: "x" * 1_000_000, 3: "a short text of a few words", 4: many + " more"}
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.encode_and_decode(frame, ranks, public_tokenizers.PATTERN).collect()} == texts
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_files.tokenize_to_files(frame, path, 2).count() == 4
    assert {r.n_words for r in quality_rules.assess(frame, labels).collect()} == {600_000, 1, 7, 600_001}
    assert line_dedup.remove_boilerplate(frame).count() == 4 and sharding.assign_shards(frame).count() == 4
    assert sorted(r["size"] for r in mixing.mix_report(frame).collect()) == [1, 7, 600_000, 600_001]
    assert nbsvm.classify_quality(frame, labels).count() == 4 and toxicity.score_toxicity(frame, labels).count() == 4


def test_text_ids(spark):
    frame = spark.createDataFrame([(f"d{i}", BASE[i % 12], "s") for i in range(30)], "doc_id string, text string, source string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, i % 2) for i in range(30)], "doc_id string, quality int, toxic int")
    assert toxicity.score_toxicity(frame, labels).count() == 30 and nbsvm.classify_quality(frame, labels).count() == 30
    assert sorted(r.doc_id for r in simhash.drop_near_copies(frame).collect()) == sorted(min(f"d{k}" for k in range(i, 30, 12)) for i in range(12))


def test_rules_scored_by_walking_each_tree(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    trees = quality_rules.fit_rules(documents, labels)
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for r in quality_rules.assess(documents, labels).collect():
        x = quality_rules.features(np.array([quality_stats.document_stats(texts[r.doc_id])]))[0]
        margin = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if x[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            margin += trees.value[node]
        score = 1 / (1 + np.exp(-margin))
        assert r.score == pytest.approx(score) and r.kept == (not r.base_failed and score >= 0.5)


def test_components_joined_by_further_edges(spark):
    rng = np.random.default_rng(15)
    pairs = [tuple(int(x) for x in p) for p in rng.integers(0, 200, (150, 2))]
    frame = spark.createDataFrame(pairs, "u long, v long")
    first = components.connected_components(frame.limit(0).unionByName(spark.createDataFrame(pairs[:90], "u long, v long")))
    out = {r.node: r.root for r in components.joined_components(first, spark.createDataFrame(pairs[90:], "u long, v long")).collect()}
    whole = {r.node: r.root for r in components.connected_components(frame).collect()}
    assert all((out[a] == out[b]) == (whole[a] == whole[b]) for a in whole for b in whole) and set(whole) <= set(out)
