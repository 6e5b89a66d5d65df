"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled documents at most, drawn by a hash of the id. ``id_col`` and ``text_col`` are those of ``docs``.

    ``keep``, of the id column, says which rows may be learned from. Labels that are null or contradict each
    other for one id are left out; a document that occurs more than once counts once, with the least of its texts. The labels
    drawn are a few bytes a row, so their table may be broadcast.
    """
    given = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if keep:
        given = given.where(keep(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most")).where("label = _most")
    total = given.count()
    if total > rows:
        given = given.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    drawn = F.broadcast(given.select("doc_id", F.col("label").cast("int").alias("label")))
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(drawn, "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
