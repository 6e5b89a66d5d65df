"""Near copies: which pairs are compared at all."""

import numpy as np

from tessera.llm import simhash


def test_a_template_is_not_paired_with_itself(spark, monkeypatch):
    rng = np.random.default_rng(31)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]

    def filled(n):
        words = list(base)
        for at in rng.choice(300, n, replace=False):
            words[at] = f"v{rng.integers(10**9)}"
        return words

    texts = [filled(10) for _ in range(80)] + [filled(2) for _ in range(5)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    group = list(range(len(sets)))
    for _ in range(5):
        for a in group:
            for b in group:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    compared, alike = [], simhash.Prefix.alike
    monkeypatch.setattr(simhash.Prefix, "alike", lambda self, pairs, live: compared.append(pairs.count()) or alike(self, pairs, live))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(frame, pairs_side=16).collect())
    assert kept == sorted(set(group))
    assert sum(compared) < 400  # of 3,570 pairs, all of which share a lookup
