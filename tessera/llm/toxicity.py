"""Toxic spans tagged by a linear-chain conditional random field, and documents scored by their marginals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.crf import Chain, fit_chain, marginals, plain, word_features
from tessera.llm.labelled import fold_of, labelled_sample
from tessera.llm.shared import staged, text_batches

#: Whole words, and prefixes of these lengths, are weighed as signs of a toxic document.
SIGN_PREFIXES = (5, 6, 7, 8, 9)
WINDOW = 12
#: Tagged windows of a toxic document, and clean ones of a clean document, that teach the chain.
WINDOWS = (5, 2)


@dataclass(frozen=True)
class Toxicity:
    """The chain, and the logistic curve from a document's marginals to its score: offset and slopes."""

    chain: Chain
    curve: tuple[float, float, float]


def _signs(word: bytes) -> list[bytes]:
    text = word.decode(errors="replace")
    return [b"=" + word, *(text[:k].encode() for k in SIGN_PREFIXES if len(text) > k)]


def learn_signs(sample: DataFrame, *, least_documents: int = 5, least_share: float = 0.85, most: int = 5_000) -> set[bytes]:
    """Words and prefixes that mark a toxic document.

    In ``least_documents`` toxic documents of the sample or more, which are at least ``least_share`` of all that have
    it (of 1 more that is clean, for caution); at most ``most``, the most frequent.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch["text"], batch["label"]):
                words = {plain(w) for w in (text or "").encode().split()}
                (toxic if label else clean).update({s for w in words if w for s in _signs(w)})
            yield pd.DataFrame([(s, n, clean[s]) for s, n in toxic.items()] + [(s, 0, n) for s, n in clean.items() if s not in toxic], columns=["sign", "toxic", "clean"])

    counts = sample.mapInPandas(count, "sign binary, toxic long, clean long").groupBy("sign").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    marked = counts.where((F.col("toxic") >= least_documents) & (F.col("toxic") >= least_share * (F.col("toxic") + F.col("clean") + 1)))
    return {bytes(r["sign"]) for r in marked.orderBy(F.desc("toxic"), "sign").limit(most).collect()}


def tagged_windows(sample: DataFrame, signs: set[bytes], window: int = WINDOW, windows: tuple[int, int] = WINDOWS) -> list[tuple[list[bytes], list[int]]]:
    """Token sequences of labelled documents: of toxic ones around tokens with a sign, which are tagged; of clean ones from anywhere, untagged.

    ``windows``: the most of a toxic document, and those of a clean one. Which they are a hash of id and place decides, over the whole text, whatever its length; a toxic document's tokens
    with a sign are at least two windows apart to have one each. ``window``: tokens on either side of the middle.
    """

    @F.pandas_udf("array<struct<words:array<binary>, tags:array<int>>>")
    def cut(ids: pd.Series, texts: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([_windows(i, t, y, signs, window, windows) for i, t, y in zip(ids, texts, labels)])

    rows = sample.select(F.col("doc_id"), F.explode(cut("doc_id", "text", "label")).alias("w")).select("doc_id", "w.*").collect()
    return [([bytes(w) for w in r["words"]], list(r["tags"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def _windows(doc_id, text: str | None, label: int, signs: set[bytes], window: int, windows: tuple[int, int]) -> list[dict]:
    words = [plain(w) for w in (text or "").encode().split()]
    tags = [int(bool(label) and bool(w) and any(s in signs for s in _signs(w))) for w in words]
    starts = []
    for i in np.flatnonzero(tags).tolist():
        if not starts or i >= starts[-1] + 2 * window:
            starts.append(max(0, i - window))
    starts = sorted(sorted(starts, key=lambda s: xxhash.xxh64_intdigest(f"{doc_id}:{s}"))[: windows[0]])
    if words and not label:
        starts += [xxhash.xxh64_intdigest(str(doc_id), k) % len(words) for k in range(windows[1])]
    return [{"words": words[s : s + 2 * window + 1], "tags": tags[s : s + 2 * window + 1]} for s in starts]


class _Sums(dict):
    """Numbers of words, by their first use, and each one's sums of weights: its own, and what it adds as the word before and behind another."""

    def __init__(self, weight: list[float], bits: int):
        self.weight, self.bits = weight, bits
        self.rows: list[tuple[float, float, float]] = []

    def __missing__(self, word: bytes) -> int:
        own, before, behind = word_features(plain(word), self.bits)
        number = self[word] = len(self.rows)
        self.rows.append((sum(map(self.weight.__getitem__, own)), self.weight[before], self.weight[behind]))
        return number


class Tagger:
    """Emissions of texts under a chain. Words' sums of weights are remembered, up to a bound."""

    def __init__(self, chain: Chain, remember: int = 200_000):
        self.remember, self.bits, self.weight = remember, chain.bits, chain.weight.tolist()
        self.reset()

    def reset(self) -> None:
        self.known = _Sums(self.weight, self.bits)
        self._made = self._table = np.zeros((0, 3))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.remember:
            self.reset()
        if not words:
            return np.zeros(0)
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sums = self.known.rows
        if len(new := sums[len(self._made) :]):
            if len(sums) > len(self._table):
                self._table = np.concatenate([self._made, np.zeros((max(4096, len(sums)), 3))])
            self._table[len(self._made) : len(sums)] = new
            self._made = self._table[: len(sums)]
        sums = self._made[numbers]
        out = sums[:, 0].copy()
        out[1:] += sums[:-1, 1]
        out[:-1] += sums[1:, 2]
        return out


def _summary(odds: np.ndarray) -> tuple[float, float]:
    """A document's largest marginal, as log-odds within +-12, and log of 1 plus its expected number of toxic tokens."""
    if not len(odds):
        return -12.0, 0.0
    p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return float(np.clip(odds.max(), -12, 12)), float(np.log1p(p[odds > -5].sum()))


def _fit_curve(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 60) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; slopes are kept at 0 or more, so more marks never lower a score."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        pull = l2 * np.array([0, 1, 1])
        step = np.linalg.solve(design.T @ (design * h[:, None]) + np.diag(pull + 1e-6), design.T @ (p - y) + pull * w)
        w = w - np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(map(float, w))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 4, held_out: int = 2, train_rows: int = 8_000, bits: int = 18, windows: tuple[int, int] = WINDOWS,
) -> Toxicity:
    """Chain and curve from labelled documents outside the held-out fold, about ``train_rows`` at most, with so many ``windows`` of each toxic and clean one for the chain.

    Labels are of documents, so tokens are labelled first: those with a sign, in toxic documents. Three in four documents
    teach signs and chain; all set the curve, from marginals that the chain gives them.
    What reaches the driver are signs, short windows, and two numbers a document.
    """
    text_batches(docs.sparkSession)
    sample = staged(labelled_sample(docs, labels, "toxic", train_rows, lambda i: fold_of(i, folds) != held_out, id_col, text_col), "toxic-sample")
    teach = sample.where(F.pmod(F.xxhash64(F.lit("teach"), "doc_id"), F.lit(4)) > 0)
    chain = fit_chain(tagged_windows(teach, learn_signs(teach), windows=windows), bits)
    unfitted = Toxicity(chain, (0.0, 0.0, 0.0))
    rows = sample.select("doc_id", "label", tag_documents(unfitted, F.col("text")).alias("t")).select("doc_id", "label", "t.largest", "t.expected").toPandas().sort_values("doc_id")
    y = rows["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Toxicity(chain, (float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0, 0.0))
    return Toxicity(chain, _fit_curve(rows[["largest", "expected"]].to_numpy(float), y))


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SPAN = "start:int, end:int, text:string, probability:double"


def _spans(text: str, odds: np.ndarray, least: float) -> list[dict]:
    """Runs of tokens whose marginal is ``least`` or more; the text is searched for its words only if there are any."""
    over = np.flatnonzero(odds >= np.log(least / (1 - least)))
    if not len(over):
        return []
    words, out, last = list(_WORDS.finditer(text)), [], -2
    for i in over.tolist():
        p = float(1 / (1 + np.exp(-min(odds[i], 30.0))))
        if i == last + 1:
            out[-1] |= {"end": words[i].end(), "probability": max(out[-1]["probability"], p)}
        else:
            out.append({"start": words[i].start(), "end": words[i].end(), "probability": p})
        last = i
    return [s | {"text": text[s["start"] : s["end"]]} for s in out]


def tag_documents(model: Toxicity, text: Column, least: float = 0.5) -> Column:
    """For each text: score (0 to 1), largest (log-odds of the largest marginal), expected (log of 1 plus the expected toxic tokens), and spans.

    spans: an array of (start, end, text, probability), runs of tokens whose marginal is ``least`` or more. Offsets count
    code points; a run's probability is its largest marginal.
    """

    @F.pandas_udf(f"score double, largest double, expected double, spans array<struct<{_SPAN}>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model.chain)
        for batch in batches:
            texts = [t or "" for t in batch]
            odds = marginals([tagger.emissions(t.encode().split()) for t in texts], model.chain)
            x = np.array([_summary(o) for o in odds]).reshape(-1, 2)
            offset, largest, expected = model.curve
            score = 1 / (1 + np.exp(-np.clip(offset + largest * x[:, 0] + expected * x[:, 1], -30, 30)))
            yield pd.DataFrame({"score": score, "largest": x[:, 0], "expected": x[:, 1], "spans": pd.Series([_spans(t, o, least) for t, o in zip(texts, odds)], dtype=object)})

    return of(text)


def toxic_spans(model: Toxicity, text: Column, least: float = 0.5) -> Column:
    """The spans of ``tag_documents``."""
    return tag_documents(model, text, least)["spans"]


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: (``id_col``, held_out, score, predicted, spans: the offending places, see ``tag_documents``).

    Fitted on labels outside the fold ``held_out`` of crc32(id as text) modulo ``folds``; id, language, source and
    labels are no inputs of a score. Null, empty and blank texts get the score of a document without any
    token, and no spans. A null id is in no fold (held_out is null). Repeated rows keep a row each; other columns are not
    read. Without usable labels all scores are 0.5. An empty input gives an empty result.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, folds=folds, held_out=held_out)
    scored = docs.select(F.col(id_col), (fold_of(F.col(id_col), folds) == held_out).alias("held_out"), tag_documents(model, F.col(text_col)).alias("t"))
    return scored.select(id_col, "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= threshold).cast("int").alias("predicted"), F.col("t.spans").alias("spans"))
