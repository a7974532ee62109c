"""The corpus pipeline: five stages over `documents`, each on all that the one before kept.

Language identification drops documents of no language, exact dedup and the n-gram Jaccard join keep
one document of each group, personal data is replaced by tags, and packing fills sequences. All but
the last stage return the columns of documents. A stage's result is written as Parquet to the shared
folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.common import Scratch, read_documents
from kinweave.llm.exact import keep_first
from kinweave.llm.jaccard import keep_one
from kinweave.llm.langid import known_language
from kinweave.llm.packing import pack
from kinweave.llm.pii import redact


#: Words whose ids a worker keeps while it packs: executors still hold what earlier stages took.
WORDS_KEPT = 300_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, memo=WORDS_KEPT)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("pii", pii), ("best_fit_packing", best_fit_packing)]

#: Language identification and the added spans come from fitted models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir."""
    scratch, docs = Scratch(spark, "pipeline"), read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
