"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Columns (n-grams) are dealt into blocks by hash. A first product with the all-ones vector counts, by
document, the n-grams that any other document has too: a document with under 80 % of such n-grams
can have no link and drops out. Of those left, equal rows are folded into one. The product proper runs
over the columns that matter: each document's rarest ones, which two linked documents can't both miss.
A column's rows are cut into blocks and multiplied block by block; partial overlaps are added up by
pair, and a pair is discarded as soon as sizes, the places of a common column, the parities of both
rows or the overlap so far rule out a link. What is left is checked on the whole rows.

Three rounds of leaders come first, at every size: a column's rows meet some few of its rows, and what
links is joined into components. The last round multiplies all that is left, rows of different
components only; so no group of near copies is multiplied with itself in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import U, Scratch, bare, chain, lower_ascii, mix, pieces, row_of, span_hashes, text_bytes, text_volume, word_spans
from kinweave.llm.components import joined
from kinweave.llm.exchange import buckets_for, exchange

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Leaders of a column in each round before the last.
LEADERS = (1, 8, 8)
#: Rows of a column in a block of the last round.
BLOCK = 1000
#: 64-bit words of a row's parities: bit k is the parity of the number of its n-grams of class k.
PARITIES = 4


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles (64-bit) of each row, sorted by row, then value; and their rows. A
    row of fewer words has its whole sequence as the only one."""
    low = lower_ascii(data)
    starts, ends, first = word_spans(low, offsets)
    h = span_hashes(low, starts, ends)
    del low, starts, ends
    row = row_of(first)
    full = chain(h, n)
    ok = row[: len(full)] == row[n - 1 :]
    key, of = full[ok], row[: len(full)][ok]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = []
        for r in short.tolist():
            x = np.array([count[r]], U)
            for w in h[first[r] : first[r + 1]]:
                x = mix(x * U(0xD1342543DE82EF95) + w)
            whole.append(x[0])
        key, of = np.concatenate([key, np.array(whole, U)]), np.concatenate([of, short])
    del h, full, row, ok
    order = np.argsort(key)
    order = order[np.argsort(of[order], kind="stable")]
    key, of = key[order], of[order]
    del order
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return key[new], of[new]


def shared_counts(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """doc_id, key, n_shingles, n_shared, sign: the set's size, how many of it other rows have too,
    and a 128-bit fingerprint of the set in two longs."""

    def keys_of(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        keys, rows = shingles(data, offsets, n)
        size = np.bincount(rows, minlength=batch.num_rows)
        first = np.concatenate([[0], np.cumsum(size)])
        signs = []
        for salt in (1, 2):
            total = np.zeros(len(keys) + 1, U)
            np.cumsum(mix(keys * U(2 * salt + 1) + U(salt)), out=total[1:])
            signs.append(mix(total[first[1:]] - total[first[:-1]] + size.astype(U)).view(np.int64))
        ids = batch.column("doc_id")
        known = pa.compute.is_valid(ids).to_numpy(zero_copy_only=False)
        home = {"doc_id": pa.compute.fill_null(ids, 0).to_numpy(), "known": known, "key": batch.column("key").to_numpy(), "size": size.astype(np.int64), "sign1": signs[0], "sign2": signs[1]}
        return keys, rows, rows, home

    def answer(home: dict[str, bytes], tags: np.ndarray) -> pa.Table:
        size = np.frombuffer(home["size"], np.int64)
        known = np.frombuffer(home["known"], bool)
        return pa.table(
            {
                "doc_id": pa.array(np.frombuffer(home["doc_id"], np.int64), mask=~known), "key": np.frombuffer(home["key"], np.int64), "n_shingles": size,
                "n_shared": np.bincount(tags, minlength=len(size)), "sign1": np.frombuffer(home["sign1"], np.int64), "sign2": np.frombuffer(home["sign2"], np.int64),
            }
        )

    return exchange(docs, buckets, keys_of, answer, "doc_id long, key long, n_shingles long, n_shared long, sign1 long, sign2 long", across_rows=True, exact=False, chunk_bytes=2 << 20)


def parities(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows, PARITIES words: two rows whose words differ in d bits differ in at least d
    of their keys."""
    out = np.zeros((PARITIES, n), U)
    if len(keys):
        at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        word, bit = (keys >> U(6)) % U(PARITIES), U(1) << (keys & U(63))
        for k in range(PARITIES):
            out[k, rows[at]] = np.bitwise_xor.reduceat(np.where(word == k, bit, U(0)), at)
    return out.view(np.int64)


_PARITIES = [f"p{k}" for k in range(PARITIES)]


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, key, the row's distinct shingles as a sorted array, and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys, rows = shingles(*text_bytes(batch.column("text")), n)
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))])
            grams = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "grams": grams} | dict(zip(_PARITIES, parities(keys, rows, batch.num_rows), strict=True)))

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, grams array<long>, " + ", ".join(f"{p} long" for p in _PARITIES))


def _enough(overlap: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """Whether two rows of these sizes that share so many columns, at the most, can be linked."""
    return overlap * (num + den) >= num * (a + b)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of documents that are linked: overlaps of the two whole rows."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.filter(_enough(F.size(F.array_intersect("ga", "gb")), F.size("ga"), F.size("gb"), num, den)).select("a", "b")


def _first_columns(sets: DataFrame, num: int, den: int) -> DataFrame:
    """The cells of the matrix that two linked rows can't both miss: doc_id, key, size, n (n-grams that
    other rows have too), at (the column's place among those), short, gram.

    Columns are in a global order, rare ones first; those of one row only come before all others and
    drop out. Two rows of sizes y <= x that are linked have a common column among the first
    x - ceil(num x / den) + 1 of the larger and the first y - ceil(2 num y / (num + den)) + 1 of the
    smaller; `short` marks the latter."""
    cells = sets.select("doc_id", "key", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    held = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    w = Window.partitionBy("doc_id", "key")
    ranked = cells.join(held, "gram").withColumn("at", F.row_number().over(w.orderBy("df", F.xxhash64("gram"), "gram"))).withColumn("n", F.count(F.lit(1)).over(w))
    place = F.col("at") + F.col("size") - F.col("n")
    upto = lambda p, q: F.col("size") - F.ceil(F.col("size") * p / q) + 1
    return ranked.filter(place <= upto(num, den)).select("doc_id", "key", "size", "n", "at", (place <= upto(2 * num, num + den)).alias("short"), "gram")


def _met(a: DataFrame, b: DataFrame, on: list[str], more: Column, num: int, den: int) -> DataFrame:
    """Pairs of rows of `a` and `b`, tables of cells, that have a common column and that no bound rules
    out: sizes, places of the common column, parities. One row for each common column."""
    a, b = (df.select(*[F.col(c).alias(f"{x}_{c}") for c in df.columns]) for x, df in (("a", a), ("b", b)))
    enough = lambda overlap: _enough(overlap, F.col("a_size"), F.col("b_size"), num, den)
    most = F.least("a_at", "b_at") + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    apart = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in _PARITIES), F.lit(0))
    fits = den * F.least("a_size", "b_size") >= num * F.greatest("a_size", "b_size")
    near = fits & enough(most) & enough((F.col("a_size") + F.col("b_size") - apart) / 2)
    same = reduce(and_, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in on])
    met = a.join(b, same & (F.col("a_c") != F.col("b_c")) & near & more)
    return met.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b"), "a_size", "b_size")


def jaccard_classes(docs: DataFrame, n: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR, keys: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Documents with equal sets are linked;
    those without words have an empty set and no link. No pair is lost: the shared-count test and the
    first-fifth test only drop what can't reach num / den. Rows that repeat a doc_id are separate
    rows of one class. Rows without doc_id make no links; they get the class of a row with an equal set,
    if there is one, else null. With `keys` a hash of doc_id and text comes along. Very long texts are
    handled whole, as the largest piece of a batch. Ties are broken by doc_id. Extra columns are ignored;
    an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = bare(docs, "text").withColumn("key", F.xxhash64("doc_id", "text"))
    _, volume = text_volume(docs)
    every = scratch.save(shared_counts(docs, n, buckets_for(2 * volume)))
    may = every.filter((F.col("n_shingles") > 0) & (den * F.col("n_shared") >= num * F.col("n_shingles")) & F.col("doc_id").isNotNull())
    # rows with equal sets: one document stands for them
    folded = scratch.save(may.groupBy("sign1", "sign2", "n_shingles").agg(F.min("doc_id").alias("stands"), F.min_by("key", "doc_id").alias("key")))
    stand = folded.select(F.col("stands").alias("doc_id"), "key")
    sets = scratch.save(sets_of(docs.join(stand, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]), n))
    cells = scratch.save(_first_columns(sets, num, den))
    rows = sets.select("doc_id", "key", *_PARITIES)
    label = None
    for turn, leaders in enumerate([*LEADERS, None]):
        by_row = rows.withColumn("c", F.col("doc_id")) if label is None else rows.join(label, rows.doc_id == label.node, "left").select(*rows.columns, F.coalesce("component", "doc_id").alias("c"))
        now = cells.join(by_row, ["doc_id", "key"])
        # columns that hold two components or more
        held = now.groupBy("gram").agg(F.count(F.lit(1)).alias("held"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("gram", "held")
        now = now.join(held, "gram").drop("key")
        if leaders:  # any pair that is met and linked may join components: counting waits for the last round
            draw = F.xxhash64("doc_id", F.lit(turn)) if leaders == 1 else F.xxhash64("doc_id", "gram", F.lit(turn))
            kind = F.pmod(F.xxhash64("doc_id", F.lit(turn + 100)), F.lit(leaders))
            now = now.withColumn("kind", kind).withColumn("leads", F.row_number().over(Window.partitionBy("gram", "kind").orderBy(draw)) == 1)
            now = scratch.save(now.drop("kind", "held"))
            pairs = _met(now, now.filter("leads"), ["gram"], F.lit(True), num, den).select("a", "b").distinct()
        else:
            now = scratch.save(now)
            blocks = F.ceil(F.col("held") / BLOCK)
            own, other = F.pmod(F.xxhash64("doc_id", F.lit(7)), blocks), F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
            a = now.filter("short").withColumn("i", own.cast("int")).withColumn("j", other)
            b = now.withColumn("j", own.cast("int")).withColumn("i", other)
            met = _met(a, b, ["gram", "i", "j"], F.struct("a_size", "a_doc_id") < F.struct("b_size", "b_doc_id"), num, den)
            # overlaps so far, by pair; other common columns come after the last cell of one of the rows
            counted = met.groupBy("a", "b", "a_size", "b_size").agg(F.count(F.lit(1)).alias("overlap"))
            rest = F.greatest(F.ceil(F.col("a_size") * 2 * num / (num + den)), F.ceil(F.col("b_size") * num / den)) - 1
            pairs = counted.filter(_enough(F.col("overlap") + rest, F.col("a_size"), F.col("b_size"), num, den))
        found, seen = scratch.save_with(_verified(pairs, sets, num, den), links=F.lit(1))
        if seen["links"]:
            label = joined(label, found, scratch)
        scratch.drop(now, found)
    stands = folded.select("sign1", "sign2", "n_shingles", "stands")
    if label is not None:
        stands = stands.join(label, stands.stands == label.node, "left").select("sign1", "sign2", "n_shingles", F.coalesce("component", "stands").alias("stands"))
    own = F.when((F.col("n_shingles") > 0) & (den * F.col("n_shared") >= num * F.col("n_shingles")), F.col("stands"))
    out = every.join(stands, ["sign1", "sign2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce(own, F.col("doc_id")).alias("component_id"), *["key"] * keys)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one with the smallest doc_id.

    Of rows that repeat a doc_id, those in its own class stay. A row without doc_id goes only if a row
    with one has an equal set. Rows equal in doc_id and text stay or go together. Texts without words
    stay; all columns pass through; an empty table stays empty.
    """
    kept = jaccard_classes(docs, keys=True).filter("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    mine = F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (mine == kept["kept_key"]), "left_semi")
