"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import SPACE, Scratch, bare, pieces, row_sums, text_bytes
from kinweave.operators.ordered import number_within, sums_before

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Times that a source, and so a document, may be taken.
MOST = 3
SEED = 20
_MEASURED = "doc_id long, source string, size long, n_bytes long, n_letters long"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = text_bytes(batch.column("text"))
        inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = offsets[:-1][np.diff(offsets) > 0]
        first[edge] = inside[edge]
        columns = [row_sums(x, offsets) for x in (first, inside, _LETTER[data])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *map(pa.array, columns)], names=["doc_id", "source", "size", "n_bytes", "n_letters"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), n_bytes (of words) and n_letters (those of them in letters)."""
    return bare(docs, "source", "text").withColumn("source", F.col("source").cast("string")).mapInArrow(_measure, _MEASURED)


def quality() -> Column:
    """A document's weight from 0.1 to 1: the share of letters in its words. No text: 0.1."""
    return F.when(F.col("n_bytes") > 0, (F.col("n_bytes") + 9 * F.col("n_letters")) / (10 * F.col("n_bytes"))).otherwise(0.1)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """sources (source, source_size) with `target`: `share` of all sizes dealt out by weight, none above `most`
    times its source's size, the excess reshared by weight among the others.

    Resharing until none is above ends where a level L gives each source min(weight * L, most * size), and the
    sources that stop are the first ones by size / weight. So two running sums find L: there are no rounds.
    Sources are in code point order, null last."""
    # long: a weight times some hundred million words is beyond an int
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = number_within(sources, [], [F.asc_nulls_last("source")], "_rank").withColumn("_w", weight)
    ranked = sums_before(ranked, [], [F.col("source_size") / F.col("_w"), F.col("_rank")], {"_stopped": most * F.col("source_size"), "_gone": F.col("_w")})
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    total = share * (total or 0) if share != 1 else total or 0
    stops = F.col("_w") * (F.lit(total) - F.col("_stopped")) / (F.lit(all_weights or 0) - F.col("_gone")) > most * F.col("source_size")
    ranked = ranked.withColumn("_stops", stops)
    size, gone = ranked.filter("_stops").agg(F.coalesce(F.sum(most * F.col("source_size")), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    level = (F.col("_w") * F.lit(total - size)).cast("double") / F.lit(float((all_weights or 0) - gone) or 1.0)
    return ranked.select("source", "source_size", F.when(F.col("_stops"), (most * F.col("source_size")).cast("double")).otherwise(level).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, epochs.

    A source's target (see `targets`) is rounded to whole words. It takes all of its documents as often as the
    target holds them (complete epochs); the rest is filled by a weighted random part without replacement:
    documents in the order of their exponential keys -ln(u) / quality (Efraimidis and Spirakis, 2006), until
    their sizes add up to the rest. The document that crosses it gives its first words only, so a source's
    taken words equal its rounded target, however long its documents are.

    u comes from the MD5 of seed and doc_id, so reruns agree. Keys that tie go by doc_id, then size; repeated
    rows are rows of their own. A null doc_id, source or text: a key from an empty id, a source of its own
    (the last one), size 0. Documents without words take none. Empty tables give no rows; texts are measured
    whole, in batches of bounded bytes; other columns are ignored. A source of most rows is sorted in ranges.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.save(measured(docs))
    # one row per source, written so that Spark knows its size and broadcasts it only while it is small
    plan = scratch.save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, share))
    key = F.concat_ws("#", F.lit(str(seed)), F.col("doc_id").cast("string"))
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = rows.select("doc_id", "source", "size", (-F.log(u) / quality()).alias("_key"))
    placed = sums_before(keyed, ["source"], [F.col("_key"), F.asc_nulls_first("doc_id"), F.col("size")], {"_before": F.col("size")})
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", F.floor(F.col("target") + 0.5).alias("_words"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_words") / F.col("source_size"))).otherwise(0).cast("long")
    out = placed.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("epochs", epochs)
    rest = F.col("_words") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs")
