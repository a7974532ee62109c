"""Exact dedup by a heavy-hitter split, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Scratch, bare

#: Digests the Misra-Gries summary tracks: any digest in more than 1 / SUPPORT of the rows is found.
SUPPORT = 1024


def _digest(text: Column) -> Column:
    """The SHA-256 of a text after each run of [\\x20\\x09-\\x0D] became one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of the text."""
    return bare(docs, "text").select("doc_id", _digest(F.col("text")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts (null counts as empty) form a group; its smallest doc_id stays. A Misra-Gries
    summary (DataFrame.freqItems) of at most `support` digests names the candidates for frequent
    digests. Their exact counts are then taken, and the winners (at most `support` rows, whatever
    the input) are broadcast, so rows of hot groups get their keeper on the map side and never
    meet in one task. All other digests use ordinary shuffling: partial aggregation, then a join.

    Repeated rows with one doc_id give a row each, and are kept or dropped together; a null doc_id
    never beats another. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    all_rows = scratch.save(digests(docs))
    found = all_rows.freqItems(["text_sha256"], 1.0 / support).first()
    candidates = spark.createDataFrame([(x,) for x in (found[0] or [] if found else [])], "text_sha256 string")
    sizes = lambda df: df.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = sizes(all_rows.join(F.broadcast(candidates), "text_sha256", "left_semi")).filter("group_size > 1").collect()
    hot = spark.createDataFrame(winners, "text_sha256 string, keep_id long, group_size long")
    split = all_rows.join(F.broadcast(hot), "text_sha256", "left")
    rest = split.filter("group_size is null").select("doc_id", "text_sha256")
    cold = rest.join(sizes(rest), "text_sha256")
    out = split.filter("group_size is not null").unionByName(cold)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the later rows of each group of equal texts.

    Rows are matched by doc_id and text, so one that repeats a doc_id with another text is judged for
    itself; rows equal in both stay or go together, as do rows of a group without any doc_id. Null counts
    as an empty text; all columns pass through; an empty table stays empty.
    """
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
    mine = docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (_digest(docs["text"]) == kept["text_sha256"])
    return docs.join(kept, mine, "left_semi")
