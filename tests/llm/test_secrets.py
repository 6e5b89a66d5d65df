"""Secret scans against Python's regular expressions, and the trigram queries of patterns."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.secrets import BASE, MORE, Rule, find_secrets, secret_report
from tessera.llm.trigrams import EVERYTHING, candidates, postings, trigram_query

KEY = "AKIA" + "Z9" * 8
TEXTS = [
    None, "", "   ", "no secret here", f"x {KEY} y {KEY}", "AKIA" + "A" * 13, "AKIA" + "A" * 14 + "a", "AKIAKIA" + "B" * 15, 'PassWord = "abc/def+ghi=jkl.mno"', "token:short token : 'longer-than-twelve'",
    "token:secret: abcdefghijklmnop", "token=secret=abcdefghijklmnop", "api_key==abcdefghijklmn", "apikey:\t\"abcdefghijklmn", "secret\n=abcdefghijklmnop", "ſecret=abcdefghijklmnop", "toKen=abcdefghijklmnop",
    "deadbeef" * 2, "deadbeef" * 2 + "DEADBEEF", "é𝄞ü deadbeefdeadbeef0 𝄞 token=deadbeefdeadbeefdead!", "-----BEGIN RSA PRIVATE KEY-----\nMIIE", "-----BEGIN PRIVATE KEY----- -----BEGIN EC PRIVATE KEY-----",
    "ghp_" + "a1" * 18, "ghp_" + "a" * 35, "xoxb-123456789-abc", "sk_live_" + "0aZ" * 8, "AIza" + "x_-" * 12, "eyJabc.eyJdef.sig eyJabc.eyx", "key: " + "0123456789abcdef " * 3000, "word " * 300_000 + KEY,
]


def _brute(text, rules):
    out = []
    for place, rule in enumerate(rules):
        out += [(m.start(), place, m.end(), rule.kind) for m in re.finditer(rule.pattern, text or "") if len(m[rule.group]) >= rule.least]
    return sorted(out)


def _written(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_report_as_python_finds_it(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice(["token", "=", ":", " ", '"', "'", "secret", "AKIA", "deadbeef", "0123456789", "Q7", "é", "\n", "_", "api", "key"]) for _ in range(60)) for _ in range(300)]
    texts = TEXTS + made + made[:5]
    frame = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)] + [(1, "token=abcdefghijklmnop", "y")] * 3, "doc_id long, text string, rules string").repartition(3)
    out = secret_report(frame).collect()
    assert sorted(out[0].asDict()) == ["base_sha256", "doc_id", "n_access", "n_assign", "n_hex", "spans"]
    expected = []
    for i, t in [(i if i != 3 else -1, t) for i, t in enumerate(texts)] + [(1, "token=abcdefghijklmnop")] * 3:
        base = _brute(t, BASE)
        expected.append((i, *(sum(k == r.kind for *_, k in base) for r in BASE), hashlib.sha256(_written(base).encode()).hexdigest(), _written(_brute(t, BASE + MORE))))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in out) == sorted(expected)
    assert secret_report(frame.where("doc_id < 0")).count() == 0


def test_the_base_hex_rule_is_runs_of_sixteen(spark):
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("0af z") for _ in range(400))
        assert [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16] == [m.span() for m in re.finditer(BASE[2].pattern, text)]


@pytest.mark.parametrize("rule", BASE + MORE, ids=lambda r: r.kind)
@settings(max_examples=40, deadline=None)
@given(data=st.data())
def test_every_match_meets_its_query(rule, data):
    text = data.draw(st.from_regex(rule.pattern)).lower()
    assert any(all(t in text for t in all_of) for all_of in trigram_query(rule.pattern))


def test_queries_of_patterns():
    q = lambda *alternatives: frozenset(frozenset(a.split()) for a in alternatives)
    assert trigram_query("abcd") == q("abc bcd") and trigram_query("[Aa]b(c|d)") == q("abc", "abd")
    assert trigram_query("[a-z]+") == trigram_query("ab|xyz") == trigram_query("(abc)*") == EVERYTHING
    assert trigram_query("abc.*def") == q("abc def") and trigram_query("(abcd|abc)x?") == q("abc")
    assert trigram_query("ab{3}") == q("abb bbb") and trigram_query("(ab){2,}") == q("aba bab") and trigram_query("é?abc") == q("abc")
    assert trigram_query("(abc.|def)+") == q("abc", "def") and trigram_query("(?=x)abc$") == q("abc")


def test_postings_and_their_intersection(spark):
    rows = spark.createDataFrame([(1, "xABCDx"), (2, "abc"), (3, "bcd abx"), (1, "abc bcd"), (4, None)], "key long, text string")
    trigrams = ["abc", "bcd", "zzz"]
    index = postings(rows, trigrams, "key", "text")
    assert sorted(tuple(r) for r in index.collect()) == [(0, 1), (0, 2), (1, 1), (1, 3)]
    queries = {"both": frozenset([frozenset(["abc", "bcd"])]), "either": frozenset([frozenset(["abc"]), frozenset(["bcd"])]), "none": frozenset([frozenset(["zzz"])])}
    assert sorted((r.key, r.rules) for r in candidates(index, queries, trigrams).collect()) == [(1, ["both", "either"]), (2, ["either"]), (3, ["either"])]


def test_rules_of_ones_own(spark):
    docs = spark.createDataFrame([("a", "id-77 id-1234"), ("b", "zz")], "name string, body string")
    out = find_secrets(docs, (Rule("id", r"id-([0-9]+)", 1, 3), Rule("z", "z")), "name", "body").collect()
    assert sorted((r.name, [(s.kind, s.start, s.end) for s in r.found]) for r in out) == [("a", [("id", 6, 13)]), ("b", [("z", 0, 1), ("z", 1, 2)])]
    with pytest.raises(ValueError, match="nothing"):
        find_secrets(docs, (Rule("x", "a*"),), "name", "body")
    assert find_secrets(docs, (Rule("z", "z"),), "name", "body").where(F.size("found") > 0).count() == 1
