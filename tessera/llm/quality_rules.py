"""Quality rules: fixed limits on repetition and length, then boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.gbt import Trees, fit_trees
from tessera.llm.labelled import labelled_sample
from tessera.llm.quality_stats import BASE, MORE, document_stats
from tessera.llm.shared import text_batches

#: Feature and its constraint: -1 where more of it may never make a document better.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "punctuation_per_word": 0, "end_marks_per_word": 0, "distinct_share": 0, "longest_word": -1, "top_word_share": -1, "short_share": 0,
    "words_per_line": 0,
}
_STATS = (*BASE, *MORE)


def features(stats: np.ndarray) -> np.ndarray:
    """Rows of statistics (in the order of BASE, MORE) as rows of FEATURES; shares of nothing are 0."""
    s = dict(zip(_STATS, stats.astype(float).T))
    per = lambda a, b: a / np.maximum(b, 1)
    return np.stack([
        np.log1p(s["n_words"]), per(s["word_chars"], s["n_words"]), per(s["n_symbols"], s["word_chars"]), per(s["n_dup_lines"], s["n_lines"]),
        per(s["n_repeat_words"], s["n_words"]), per(s["upper"], s["n_bytes"]), per(s["digits"], s["n_bytes"]), per(s["punctuation"], s["n_words"]),
        per(s["end_marks"], s["n_words"]), per(s["distinct_words"], s["n_words"]), s["longest_word"], per(s["top_word"], s["n_words"]),
        per(s["short_words"], s["n_words"]), per(s["n_words"], s["n_lines"]),
    ], axis=1)


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, train_rows: int = 20_000) -> Trees:
    """Trees fitted to ``quality`` on the statistics of about ``train_rows`` labelled documents at most.

    The statistics are taken in Spark; what reaches the driver is a few numbers for each document of the sample.
    """
    text_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", train_rows, None, id_col, text_col)
    of = _stats_udf()
    rows = sample.select("doc_id", "label", of("text").alias("s")).select("doc_id", "label", "s.*").toPandas().sort_values("doc_id")
    return fit_trees(features(rows[list(_STATS)].to_numpy()), rows["label"].to_numpy(float), tuple(FEATURES.values()))


def _stats(texts: pa.Array) -> np.ndarray:
    return np.array([document_stats(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(_STATS))


def _stats_udf():
    @F.arrow_udf(", ".join(f"{name} long" for name in _STATS))
    def of(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in _stats(texts).T], list(_STATS))

    return of


def quality_rules(trees: Trees, text: Column, *, min_score: float = 0.5, min_words: int = 10, most_repeated: int = 20) -> Column:
    """A struct of BASE statistics, base_failed, score (of the trees) and kept, for each text.

    base_failed: fewer than ``min_words`` words, or over ``most_repeated`` percent of them in
    repeated runs of five. kept: not so, and the score is ``min_score`` or more. Null, empty and
    blank texts have no words and fail.
    """

    @F.arrow_udf(", ".join(f"{name} long" for name in BASE) + ", base_failed boolean, score double, kept boolean")
    def of(texts: pa.Array) -> pa.Array:
        stats = _stats(texts)
        base = dict(zip(BASE, stats.T))
        failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > most_repeated * base["n_words"])
        score = trees.probability(features(stats))
        columns = base | {"base_failed": failed, "score": score, "kept": ~failed & (score >= min_score)}
        return pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    return of(text)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: (``id_col``, the BASE statistics, base_failed, kept, score).

    Nothing is shuffled but the labels. Null ids keep a row; repeated rows too; other columns are not
    read. Without usable labels the trees give every document the same score, 0.5, and the rules alone decide.
    An empty input gives an empty result.
    """
    trees = fit_rules(docs, labels, id_col, text_col)
    judged = docs.select(id_col, quality_rules(trees, F.col(text_col), **options).alias("q"))
    return judged.select(id_col, *(f"q.{c}" for c in (*BASE, "base_failed", "kept", "score")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they were."""
    trees = fit_rules(docs, labels, id_col, text_col)
    judged = docs.select(F.struct(*docs.columns).alias("row"), quality_rules(trees, F.col(text_col), **options).alias("rules"))
    return judged.where(F.col("rules.kept")).select("row.*")
