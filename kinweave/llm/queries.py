"""The numbered queries over `documents`, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.bpe import encode_decode
from kinweave.llm.common import read_documents
from kinweave.llm.exact import exact_dedup
from kinweave.llm.jaccard import jaccard_classes
from kinweave.llm.langid import op6_language_id
from kinweave.llm.lm import op9_lm_scoring
from kinweave.llm.merkle import audited, tampered_text
from kinweave.llm.mixing import mix
from kinweave.llm.oracle import ORACLE_SQL
from kinweave.llm.packing import pack
from kinweave.llm.pii import find, summary
from kinweave.llm.quality import quality
from kinweave.llm.repair import damage, repair
from kinweave.llm.substring import substring_dedup
from kinweave.llm.suffix import suffix_dedup

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_documents(spark, sf_dir), with_text=False)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find(read_documents(spark, sf_dir)))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_documents(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_documents(spark, sf_dir), with_text=False)


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_documents(spark, sf_dir), with_ids=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damage(conversations), conversations)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(read_documents(spark, sf_dir), tampered_text())


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_substring_dedup, op3_best_fit_packing, op4_pii, op5_ngram_jaccard_join, op6_language_id, op7_suffix_array_dedup, op8_bpe_encode_decode, op9_lm_scoring, op10_quality_rules, op11_conversation_repair, op12_merkle_manifest, op13_source_mixing)}
