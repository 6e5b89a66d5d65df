"""A training-data pipeline over ``documents``, stage by stage: each works on all that its predecessor kept.

Counted as part of the subpackage of training-data operators. ``STAGES`` are (name, function) pairs; a function takes
(spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_and_decode, read_ranks
from tessera.llm.line_dedup import remove_boilerplate
from tessera.llm.mixing import mix_sources
from tessera.llm.quality_rules import keep_good
from tessera.llm.queries import tokenizer_file
from tessera.llm.shared import WORD_PATTERN, pooled, staged, table
from tessera.llm.simhash import drop_near_copies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL expresses boosted trees, SimHash or ranked merges; stages are tested against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the rules on length and repetition nor the boosted trees reject."""
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sources share; those that lose their last word so are gone."""
    cleaned = remove_boilerplate(docs.select(*COLUMNS))
    emptied = (F.col("removed_lines") > 0) & ~F.col("text").rlike(WORD_PATTERN)
    return cleaned.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each piece of a document in a block, as often as the mix takes it."""
    return mix_sources(docs.select(*COLUMNS), carry=("lang",)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every piece, and proof that they decode to it: (doc_id, source, n_tokens, ids, decoded_sha256)."""
    import public_tokenizers

    docs = pooled(docs.select(*COLUMNS)).withColumn("key", F.struct("doc_id", "source"))
    coded = encode_and_decode(docs, read_ranks(tokenizer_file("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, id_col="key")
    return coded.select("key.doc_id", "key.source", "n_tokens", F.col("tokens").alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("mixing", mixing), ("byte-level bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is staged before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
