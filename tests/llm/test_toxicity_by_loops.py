"""Toxicity recomputed by loops for a fitted model; draws, lengths and bounds of other operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, crf, mixing, toxicity


def _logsum(*xs):
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def _odds(words, chain):
    """Log-odds of every token's marginal, by forward and backward sums over the two states."""
    emission = []
    for i, word in enumerate(words):
        own, _, _ = crf.word_features(crf.plain(word), chain.bits)
        e = sum(chain.weight[p] for p in own)
        if i:
            e += chain.weight[crf.word_features(crf.plain(words[i - 1]), chain.bits)[1]]
        if i + 1 < len(words):
            e += chain.weight[crf.word_features(crf.plain(words[i + 1]), chain.bits)[2]]
        emission.append(e)
    step = [[0.0, chain.a], [chain.b, chain.c]]  # from, to
    forward = []
    for i, e in enumerate(emission):
        before = [0.0, -math.inf] if not i else forward[-1]
        forward.append([_logsum(*(before[s] + step[s][t] for s in (0, 1) if before[s] > -math.inf)) + (e if t else 0.0) for t in (0, 1)])
    backward = [[0.0, 0.0]]
    for e in reversed(emission[1:]):
        behind = backward[0]
        backward.insert(0, [_logsum(*(step[s][t] + (e if t else 0.0) + behind[t] for t in (0, 1))) for s in (0, 1)])
    return [f[1] + b[1] - f[0] - b[0] for f, b in zip(forward, backward)]


def test_scores_expected_tokens_and_spans_by_loops(spark):
    rng = np.random.default_rng(30)
    word = lambda: str(rng.choice(["the", "Damned,", "fool", "idiot!", "nice", "day", "é𝄞", "walk", "damnable", "sun"]))
    texts = [None, "", "  \t"] + [" ".join(word() for _ in range(int(n))) for n in rng.integers(1, 60, 60)]
    rows = [(i, t, int(any(w in (t or "") for w in ("Damned", "idiot", "damnable")))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i + 1000, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(i + 1000, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, bits=10)
    out = {r.doc_id: r.t for r in docs.select("doc_id", toxicity.tag_documents(model, F.col("text")).alias("t")).collect()}
    offset, slope, more = model.curve
    spans_seen = 0
    for i, text, _ in rows:
        found = [(m.start(), m.end()) for m in toxicity._WORDS.finditer(text or "")]
        odds = _odds([w.encode() for w in (text or "").split()], model.chain)
        p = [1 / (1 + math.exp(-x)) for x in odds]
        largest = min(12.0, max(-12.0, max(odds))) if odds else -12.0
        expected = math.log1p(sum(v for v, x in zip(p, odds) if x > -5)) if odds else 0.0
        assert out[i].largest == pytest.approx(largest, abs=1e-9) and out[i].expected == pytest.approx(expected, abs=1e-9)
        assert out[i].score == pytest.approx(1 / (1 + math.exp(-(offset + slope * largest + more * expected))), abs=1e-9)
        spans, last = [], -2
        for k, v in enumerate(p):
            if v >= 0.5:
                if k == last + 1:
                    spans[-1] = (spans[-1][0], found[k][1], max(spans[-1][2], v))
                else:
                    spans.append((*found[k], v))
                last = k
        assert [(s.start, s.end, s.text) for s in out[i].spans] == [(a, b, text[a:b]) for a, b, _ in spans]
        assert [s.probability for s in out[i].spans] == pytest.approx([v for *_, v in spans])
        spans_seen += len(spans)
    assert spans_seen > 10


def test_a_very_long_text_is_tagged_whole(spark):
    text = "calm words here " * 300_000 + "damned idiot"
    chain = crf.Chain(np.zeros(1 << 8), -6.0, 0.0, 0.0, 8)
    for w in (b"damned", b"idiot"):
        for p in crf.word_features(w, 8)[0]:
            chain.weight[p] += 9.0
    found = spark.createDataFrame([(text,)], "text string").select(toxicity.tag_documents(toxicity.Toxicity(chain, (0.0, 1.0, 0.0)), F.col("text")).alias("t")).first().t
    assert found.spans[-1].text.endswith("idiot") and found.spans[-1].end == len(text)


def test_windows_come_from_the_whole_text():
    words = ["calm"] * 4000
    for at in range(20, 4000, 100):
        words[at] = "damned"
    starts = set()
    for i in range(60):
        found = toxicity._windows(i, " ".join(words), 1, {b"=damned"}, 12, (5, 2))
        assert len(found) == 5 and all(sum(w["tags"]) >= 1 for w in found)
        rest = toxicity._windows(i, " ".join(words), 1, {b"=damned"}, 12, (100, 2))
        starts |= {k for k, w in enumerate(rest) if w in found}
        assert len(rest) == 40
    assert len(toxicity._windows(1, "a b c", 0, set(), 12, (5, 3))) == 3 and toxicity._windows(1, "", 1, set(), 12, (5, 2)) == []


def test_hypergeometric_draws():
    rng = np.random.default_rng(31)
    for good, others, take in ((30, 70, 20), (5, 5, 5), (1, 10**6, 1000), (10**6, 3, 10**6)):
        ours = np.array([mixing._drawn(rng, good, others, take) for _ in range(4000)])
        theirs = rng.hypergeometric(good, others, take, 4000)
        assert ours.min() >= max(0, take - others) and ours.max() <= min(good, take)
        assert abs(ours.mean() - theirs.mean()) < 0.1 * max(theirs.std(), 0.3) and abs(ours.std() - theirs.std()) < 0.1 * max(theirs.std(), 0.5)
    big = [mixing._drawn(rng, 10**10, 3 * 10**10, 10**10) for _ in range(300)]
    assert abs(np.mean(big) - 2.5 * 10**9) < 6 * np.std(big) / 17 and 0.85 < np.std(big) / math.sqrt(10**10 * 0.25 * 0.75 * 0.75) < 1.15
    few = sum(int(mixing._split(np.array([7, 5 * 10**9]), 25 * 10**8, (k,))[0]) for k in range(200))
    assert 550 < few < 850  # a source of few items is drawn like any other


def test_every_vector_length_is_searched(spark):
    rng = np.random.default_rng(32)
    rows = [(int(i), [float(x) for x in rng.normal(size=3 if i % 5 == 0 else 8)]) for i in range(60)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, k=4).collect()
    for i, v in rows:
        if i % 2 == 0:
            best = sorted(((-float(np.dot(v, w)), j) for j, w in rows if j != i and len(w) == len(v)))[:4]
            mine = [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == i]
            assert len(mine) == 4 and (len(v) == 8 or [j for j, _ in mine] == [j for _, j in best])


def test_fold_bytes_have_a_bound(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="65534"):
        bpe.encode_documents(docs, {b"x": 0}, r"\S+", fold_bytes=70_000)
