"""Queries of the subpackage, as ``__spark_entry__`` registers them, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.alignment import ByteLevel, Pieces, align
from tessera.llm.ann import nearest
from tessera.llm.bpe import encode_and_decode, read_ranks
from tessera.llm.hard_negatives import OP11_SQL, hard_negatives
from tessera.llm.line_dedup import OP6_SQL, remove_boilerplate
from tessera.llm.mixing import mix_report
from tessera.llm.nbsvm import classify_quality
from tessera.llm.quality_rules import assess
from tessera.llm.secrets import OP13_SQL, secret_report
from tessera.llm.sharding import assign_shards
from tessera.llm.shared import pooled, table
from tessera.llm.simhash import near_duplicates
from tessera.llm.token_files import tokenize_to_files
from tessera.llm.toxicity import score_toxicity


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies: files of an installed package, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_distance=2)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_and_decode(pooled(table(spark, sf_dir, "documents")), read_ranks(tokenizer_file("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_to_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=16)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    return hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, label=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    first = ByteLevel(tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return align(table(spark, sf_dir, "documents"), first, Pieces(tokenizer_file("piece_bpe_32k.model")))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


_QUERIES = (op1_simhash, op2_byte_bpe, op3_nearest_neighbours, op4_token_files, op5_quality_rules, op6_line_dedup, op7_quality_classifier, op8_sharding, op9_mixing, op10_toxicity, op11_hard_negatives, op12_token_alignment, op13_secret_scan)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op11_hard_negatives": OP11_SQL, "op13_secret_scan": OP13_SQL}
