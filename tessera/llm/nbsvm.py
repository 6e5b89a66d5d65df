"""Naive Bayes support vectors: hashed n-gram indicators, scaled by log-count ratios, in a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import fold_of, labelled_sample
from tessera.llm.shared import staged, text_batches

_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Hashed indicators of a text's words, runs of two words, their shapes, and words that follow themselves.

    Words are hashed once and remembered, up to a bound; pairs are hashed from their words' hashes.
    """

    def __init__(self, bits: int, remember: int = 200_000):
        self.bits, self.remember, self.known = bits, remember, {}

    @staticmethod
    def _shape(word: bytes) -> bytes:
        """Kind of each character, runs joined: A upper, a lower, 9 digit, w beyond ASCII, others as they are."""
        out = bytearray()
        for kind in word.translate(_KINDS):
            if not out or out[-1] != kind:
                out.append(kind)
        return b"\x00" + bytes(out)

    def _hashes(self, word: bytes) -> tuple[int, int]:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            digest = xxhash.xxh64_intdigest
            found = self.known[word] = (digest(word.lower(), 7), digest(self._shape(word), 7))
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Sorted numbers, below 2 ** bits, of the indicators that are set; none for a text without words."""
        words = (text or "").encode().split()
        if not words:
            return np.zeros(0, np.int64)
        of = self._hashes
        pairs = np.array([of(w) for w in words], dtype=np.uint64)
        word, shape = pairs[:, 0], pairs[:, 1]
        runs = [word, shape]
        for h in (word, shape):
            runs.append((h[:-1] * _PRIME + h[1:]) * _PRIME)
        same = int((word[1:] == word[:-1]).sum())  # runs of a word with itself, whatever the word: by share, in tenths
        runs.append((np.array([0xABCD, *range(0xABCE, 0xABCE + -(-10 * same // len(words)))], np.uint64)) * _PRIME)
        return np.unique(np.concatenate(runs) >> np.uint64(64 - self.bits)).astype(np.int64)


_KINDS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 57 if 48 <= c <= 57 else 119 if c >= 128 else c for c in range(256))


@dataclass(frozen=True)
class NbSvm:
    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int

    def score(self, indicators: np.ndarray) -> float:
        """Probability-like score of class 1."""
        margin = float(self.weight[indicators].sum()) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, dims: int, smooth: float = 1.0) -> np.ndarray:
    """log of each indicator's share among class 1 over its share among class 0, both smoothed."""
    counts = [np.bincount(np.concatenate([r for r, l in zip(rows, y) if l == c] or [np.zeros(0, np.int64)]), minlength=dims) + smooth for c in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, *, cost: float, epochs: int, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * sum of hinge losses (Hsieh et al. 2008).

    Rows are indicators times ``scale``, and a constant 1 for the bias. One dual variable at a time goes to its best
    value between 0 and the cost of its class (classes weigh equally in total), in a new order each epoch.
    """
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.maximum(np.array([np.mean(y == 0), np.mean(y > 0)]), 1e-9)
    most = cost / (2 * share[(y > 0).astype(int)])
    square = np.array([float((scale[r] ** 2).sum()) + 1.0 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r]
            slack = sign[i] * (float(w[r] @ x) + bias) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[r] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return w, bias


def _platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to labels (Platt's smoothed targets, Newton's method)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(h * margin**2).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, np.array([(g * margin).sum(), g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int, *, cost: float = 1.0, epochs: int = 20, mixed: float = 1.0, parts: int = 3) -> NbSvm:
    """The model of labelled indicator rows; its scores are calibrated on margins of rows that were left out.

    ``mixed``: how far the scaled model replaces the mean magnitude of its weights, as in Wang and Manning (2012).
    With rows of one class only, or none, every score is the smoothed share of class 1.
    """
    dims = 1 << bits
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 1) / (len(y) + 2)
        return NbSvm(np.zeros(dims, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))), bits)

    def train(at: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i] for i in at]
        ratio = log_count_ratios(own, y[at], dims)
        w, bias = dual_coordinate_descent(own, ratio, y[at], cost=cost, epochs=epochs)
        mean = np.abs(w).sum() / max(1, np.count_nonzero(w))
        return ((1 - mixed) * mean + mixed * w) * ratio if mixed < 1 else w * ratio, bias

    margin = np.zeros(len(y))
    part = np.arange(len(y)) % parts
    for k in range(parts):
        inside = np.flatnonzero(part != k)
        if not 0 < y[inside].sum() < len(inside):
            inside = np.arange(len(y))
        w, bias = train(inside)
        for i in np.flatnonzero(part == k):
            margin[i] = w[rows[i]].sum() + bias
    w, bias = train(np.arange(len(y)))
    return NbSvm(w.astype(np.float32), float(bias), *_platt(margin, y), bits)


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5, held_out: int = 0,
    train_rows: int = 10_000, bits: int = 18, most_indicators: int = 20_000_000,
) -> NbSvm:
    """The model of ``quality`` from labelled documents outside the held-out fold.

    About ``train_rows`` of them at most, and so many, in the order of a hash of their ids, that they have ``most_indicators`` indicators at most. Indicators
    are made and staged in Spark; the driver first takes two numbers of each row, to find where to stop, and then four bytes
    an indicator, which bounds it whatever the lengths of texts.
    """
    text_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", train_rows, lambda i: fold_of(i, folds) != held_out, id_col, text_col)

    @F.pandas_udf("binary")
    def indicators(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = Grams(bits)
        for texts in batches:
            yield pd.Series([grams.of(t).astype("<i4").tobytes() for t in texts], dtype=object)

    made = staged(sample.select(F.xxhash64(F.lit("train"), "doc_id").alias("draw"), "label", indicators("text").alias("x")), "quality-train")
    sizes = made.select("draw", (F.octet_length("x") / 4).cast("long").alias("n")).toPandas().sort_values("draw")
    within = sizes[sizes["n"].cumsum() <= most_indicators]
    chosen = made.where(F.col("draw") <= int(within["draw"].max())) if len(within) else made.where("draw is null")
    taken = sorted((r["draw"], r["label"], bytes(r["x"])) for r in chosen.toLocalIterator())
    return fit([np.frombuffer(x, "<i4").astype(np.int64) for _, _, x in taken], np.array([label for _, label, _ in taken], dtype=float), bits)


def quality_score(model: NbSvm, text: Column) -> Column:
    """Score (0 to 1) of each text under the model; texts without words get the score of an empty row."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = Grams(model.bits)
        for texts in batches:
            yield pd.Series([model.score(grams.of(t)) for t in texts], dtype="float64")

    return of(text)


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: (``id_col``, held_out, score, predicted).

    Fitted on labels outside the fold ``held_out`` of crc32(id as text) modulo ``folds``; id, language, source and
    labels are no inputs of a score. Null, empty and blank texts are scored as texts without any
    indicator. A null id is in no fold (held_out is null). Repeated rows keep a row each; other columns
    are not read. Without usable labels all scores are 0.5. An empty input gives an empty result.
    """
    model = fit_quality(docs, labels, id_col, text_col, folds=folds, held_out=held_out)
    scored = docs.select(F.col(id_col), (fold_of(F.col(id_col), folds) == held_out).alias("held_out"), quality_score(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
