"""Scoring by a hierarchical Pitman-Yor model.

Restaurants: one for each context (the word before, or a text's start), all sharing one parent, whose
base is uniform over the vocabulary. Words are known by their 64-bit hashes, contexts by 32 bits: the
number of a hot word, else a hash. So there are about as many restaurants as the corpus has words, and
two words share one with a chance of 2^-31. Seatings are drawn by blocked Gibbs sweeps: all customers of a word in a
restaurant get up and are seated anew, given everybody else's tables of the sweep before.

The distinct (context, word) pairs are dealt into buckets by word; those of words that make up a share
of 1 / HOT of the tokens or more (at most HOT, so a list of bounded size) are dealt by pair, so neither
a hot word nor a hot context fills a bucket. What a sweep needs of a context, its number of tables, is
summed in slots of contexts and sent back to the buckets that hold the context. Predictive
probabilities are averaged over the kept sweeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import U, Scratch, bare, lower_ascii, mix, pieces, read_documents, remainder, span_hashes, text_bytes, text_volume, word_spans

#: Stand for a text's end as a word, and for its start as a context.
END, START = U(0x5851F42D4C957F2D), U(0xD1B54A32D192ED03)
DISCOUNT, STRENGTH = (0.8, 0.6), (1.0, 5.0)  # of contexts, of their parent
SWEEPS, KEPT = 3, 2  # the last two sweeps' states are carried along
#: Bytes of text in a chunk, and meant for a bucket; rows in a chunk; buckets for each slot of contexts.
CHUNK, BUCKET, ROWS, PER_SLOT = 4 << 20, 16 << 20, 1 << 16, 8
#: Words of a share of 1 / HOT of the tokens or more are dealt by pair.
HOT = 2048
#: Texts are scored in so many parts, one after the other: what is asked and answered for one part is
#: given back before the next.
PARTS = 3
#: Up to so many customers the number of tables is drawn from its exact distribution.
EXACT = 32


# ---- packed arrays -----------------------------------------------------------------------------

_TYPES = ("|u1", "<u2", "<u4", "<i8", "<u8", "|b1")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; counts (int64, not negative) in as few bytes as the largest needs."""
    least = lambda a: next(t for t in _TYPES[:4] if not len(a) or a.max() <= np.iinfo(t).max)
    arrays = tuple(a.astype(least(a)) if a.dtype == np.int64 else a for a in arrays)
    head = np.array([len(arrays), *[x for a in arrays for x in (_TYPES.index(a.dtype.str), len(a))]], np.int64)
    planes = [a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if a.dtype.itemsize < 8 else a for a in arrays]  # bytes of one rank together
    raw = head.tobytes() + b"".join(a.tobytes() for a in planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    """The arrays of a packed value; narrowed counts stay narrow but for those of one byte or two."""
    raw = pa.decompress(value[8:], decompressed_size=int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2), 8 + 16 * n, []
    for kind, size in head.tolist():
        width = np.dtype(_TYPES[kind]).itemsize
        a = np.frombuffer(raw, np.uint8, size * width, at)
        at += a.nbytes
        out.append((np.ascontiguousarray(a.reshape(width, size).T) if 1 < width < 8 else a.copy()).reshape(-1).view(_TYPES[kind]))
    return out


def _wide(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64)


# ---- tokens and pairs --------------------------------------------------------------------------


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' hashes with an end after each row's, and n + 1 offsets."""
    low = lower_ascii(data)
    starts, ends, first = word_spans(low, offsets)
    word = np.insert(span_hashes(low, starts, ends), first[1:], END)
    return word, first + np.arange(len(first))


def pair_keys(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(word + mix(context.astype(U) + U(1)))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most CHUNK bytes of text, or one row, and of at most ROWS rows."""
    for batch in pieces(batches, CHUNK):
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def find(ordered: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in an array in order, and which of them are there."""
    at = np.minimum(np.searchsorted(ordered, keys), max(len(ordered) - 1, 0))
    return at, (ordered[at] == keys) if len(ordered) else np.zeros(len(keys), bool)


@dataclass
class Deal:
    """Where pairs go: buckets, slots of contexts, and the hot words in order."""

    buckets: int
    hot: np.ndarray

    def contexts(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The restaurant of each token: that of the word before, or of START at the start of a row.
        Codes of hot words are even and spread evenly."""
        before = np.roll(word, 1)
        before[first[:-1]] = START
        at, is_hot = find(self.hot, before)
        return np.where(is_hot, at.astype(U) << U(32 - HOT.bit_length()), (mix(before ^ U(99)) >> U(32)) | U(1)).astype(np.uint32)

    @property
    def slots(self) -> int:
        return max(1, self.buckets // PER_SLOT)

    def bucket(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        key = np.where(find(self.hot, word)[1], pair_keys(word, context), mix(word ^ U(7)))
        return (key >> U(64 - self.buckets.bit_length() + 1)).astype(np.int64)

    def slot_edges(self, contexts: np.ndarray) -> np.ndarray:
        """Where each slot begins in contexts in order, and the end."""
        return np.searchsorted(contexts, np.arange(self.slots + 1) * ((1 << 32) // self.slots))


def hot_words(docs: DataFrame) -> np.ndarray:
    """Hashes, in order, of at most HOT words with a share of about 1 / HOT of the tokens or more, by
    counts of the words that make up half as much of a chunk, on one text in eight. The list decides
    where pairs are dealt and how contexts are spelled, never a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            word, _ = tokens(*text_bytes(batch.column("text")))
            found, n = np.unique(word, return_counts=True)
            some = 2 * HOT * n >= len(word)
            yield pa.RecordBatch.from_pydict({"word": pa.array([None, *found[some].view(np.int64).tolist()], pa.int64()), "n": np.append(len(word), n[some])})

    some = docs.filter(F.pmod(F.xxhash64("text", "doc_id"), F.lit(8)) == 0)
    seen = some.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = seen.filter("word is null").first()
    if total is None:
        return np.zeros(0, U)
    found = seen.filter(F.col("word").isNotNull() & (F.col("n") * HOT >= total.n)).orderBy(F.desc("n"), "word").limit(HOT)
    return np.sort(np.array([r.word for r in found.collect()], np.int64).view(U))


def _distinct(deal: Deal, words: np.ndarray, at: np.ndarray, context: np.ndarray, counts: np.ndarray | None = None):
    """Distinct pairs (words[at], context), words in order, by bucket, word and context: buckets,
    words, contexts, counts (of pairs that come once each where `counts` is None)."""
    key = at.astype(U) << U(32) | context
    if counts is None:
        key, n = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
        key = key[first]
    w, c = words[key >> U(32)], key.astype(np.uint32)
    b = deal.bucket(w, c)
    order = np.argsort(b, kind="stable")
    return b[order], w[order], c[order], n[order]


def _placed(deal: Deal, words: np.ndarray, at: np.ndarray, context: np.ndarray):
    """As `_distinct`, but each token's place among the distinct pairs instead of counts."""
    key, of = np.unique(at.astype(U) << U(32) | context, return_inverse=True)
    w, c = words[key >> U(32)], key.astype(np.uint32)
    b = deal.bucket(w, c)
    order = np.argsort(b, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return b[order], w[order], c[order], place[of]


def _runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in order, each once, and how many pairs each has."""
    at = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.zeros(0, np.int64)
    return words[at], np.diff(np.append(at, len(words)))


def count_pairs(docs: DataFrame, deal: Deal) -> DataFrame:
    """One row per bucket: its words, their numbers of pairs, contexts and counts, in order of word and
    context. Map tasks count within a chunk first, so a pair leaves a chunk once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            word, first = tokens(*text_bytes(batch.column("text")))
            bucket, words, contexts, counts = _distinct(deal, *np.unique(word, return_inverse=True), deal.contexts(word, first))
            full, at = np.unique(bucket, return_index=True)
            cuts = [slice(a, b) for a, b in zip(at, np.append(at[1:], len(bucket)), strict=True)]
            yield pa.RecordBatch.from_pydict({"bucket": full.astype(np.int32), "pairs": pa.array([pack(*_runs(words[x]), contexts[x], counts[x]) for x in cuts], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table["pairs"].to_pylist()]
        words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        at = np.repeat(at, np.concatenate([p[1] for p in parts]))
        _, words, contexts, counts = _distinct(deal, words, at, np.concatenate([p[2] for p in parts]), np.concatenate([_wide(p[3]) for p in parts]))
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "pairs": pa.array([pack(*_runs(words), contexts, counts)], pa.binary())})

    return docs.select("text").mapInArrow(send, "bucket int, pairs binary").groupBy("bucket").applyInArrow(merge, "bucket int, pairs binary")


@dataclass
class Bucket:
    """One bucket's pairs and their seating: tables of repeated pairs and the parent's tables of words."""

    words: np.ndarray
    sizes: np.ndarray
    contexts: np.ndarray
    counts: np.ndarray
    drawn: np.ndarray  # a pair with one token has one table
    theirs: np.ndarray

    @staticmethod
    def read(pairs: bytes, state: bytes | None) -> Bucket:
        words, sizes, contexts, counts = unpack(pairs)
        drawn, theirs = unpack(state) if state is not None else (np.ones((counts > 1).sum(), np.int64), np.ones(len(words), np.int64))
        return Bucket(words, _wide(sizes), contexts, _wide(counts), _wide(drawn), _wide(theirs))

    def owners(self) -> np.ndarray:
        """The place in words of each pair's word."""
        return np.repeat(np.arange(len(self.words)), self.sizes)

    def tables(self) -> np.ndarray:
        out = np.ones(len(self.counts), np.int64)
        out[self.counts > 1] = self.drawn
        return out

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owners(), values, len(self.words)).astype(np.int64)


# ---- seating -----------------------------------------------------------------------------------


def _partitions(discount: float) -> np.ndarray:
    """log of generalised Stirling numbers: ways to seat c customers at t tables, for c up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    for c in range(2, EXACT + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            out[c, 1 : c + 1] = np.logaddexp(out[c - 1, :c], out[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - discount * t, 0)))
    return out


_WAYS = {d: _partitions(d) for d in DISCOUNT}


def reseat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose customers are all seated anew, where other dishes have `others` tables and
    a new table gets the dish with probability `parent`.

    Up to EXACT customers the number is drawn from its distribution given the others,
    ways(c, t) * prod_{j < t} (strength + discount * (others + j)) * parent^t. Beyond, customers come in
    one after the other, from the EXACT-th on in blocks that grow with those seated.
    """
    out = np.ones(len(customers), np.int64)
    for c in range(2, EXACT + 1):
        rows = np.flatnonzero(customers == c)
        for at in np.array_split(rows, len(rows) // (1 << 16) + 1) if len(rows) else ():
            t = np.arange(c)
            open_ = np.log(strength + discount * (others[at, None] + t)) + np.log(parent[at, None])
            out[at] = 1 + np.argmax(_WAYS[discount][c, 1 : c + 1] + np.cumsum(open_, axis=1) + rng.gumbel(size=open_.shape), axis=1)
    live, k = np.flatnonzero(customers > EXACT), 1
    while len(live):
        block = 1 if k < EXACT else k // 8
        w = (strength + discount * (others[live] + out[live])) * parent[live]
        p = w / (w + k + (block - 1) / 2 - discount * out[live])
        out[live] += rng.binomial(np.minimum(customers[live] - k, block), p)
        k += block
        live = live[customers[live] > k]
    return out


@dataclass
class Totals:
    """Of a sweep: the parent's customers and tables; of the corpus: distinct words and tokens; of hot
    words: tokens, customers and tables in the parent."""

    guests: int
    theirs: int
    vocabulary: int
    total: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros((3, 0), np.int64))

    def uniform(self) -> float:
        return 1 / (self.vocabulary + 1)

    def parent(self, guests: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """The parent's probabilities of words with so many customers and tables there."""
        new = (STRENGTH[1] + DISCOUNT[1] * self.theirs) * self.uniform()
        return (guests - DISCOUNT[1] * theirs + new) / (STRENGTH[1] + self.guests)


def weight(tables: np.ndarray) -> np.ndarray:
    """The weight of the parent in contexts with so many tables."""
    return STRENGTH[0] + DISCOUNT[0] * tables


def _context_tables(now: DataFrame, deal: Deal) -> DataFrame:
    """bucket, slot, totals: for the contexts of a bucket's repeated pairs, in order, how many tables
    each has in all buckets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Bucket.read(row["pairs"], row["state"])
                found, at = np.unique(b.contexts, return_inverse=True)
                sums = np.bincount(at, b.tables(), len(found)).astype(np.int64)
                wanted = np.zeros(len(found), bool)
                wanted[at[b.counts > 1]] = True
                edge = deal.slot_edges(found)
                full = np.flatnonzero(np.diff(edge))
                blobs = [pack(found[x], sums[x], wanted[x]) for x in (slice(edge[s], edge[s + 1]) for s in full)]
                yield pa.RecordBatch.from_pydict({"slot": full.astype(np.int32), "bucket": np.full(len(full), row["bucket"], np.int32), "sums": pa.array(blobs, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table["sums"].to_pylist()]
        found, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(at, np.concatenate([_wide(p[1]) for p in parts]), len(found)).astype(np.int64)
        ends = np.cumsum([len(p[0]) for p in parts])
        blobs = [pack(total[at[e - len(p[0]) : e]][p[2]]) for p, e in zip(parts, ends, strict=True)]
        return pa.table({"bucket": table["bucket"], "slot": table["slot"], "totals": pa.array(blobs, pa.binary())})

    return now.mapInArrow(send, "slot int, bucket int, sums binary").groupBy("slot").applyInArrow(add, "bucket int, slot int, totals binary")


def _sweep(now: DataFrame, totals: DataFrame, before: Totals, deal: Deal, sweep: int) -> DataFrame:
    """bucket, pairs, state, before (the state until now), guests and theirs (sums over words that aren't
    hot), hot (places and tables of hot words). Draws are seeded by bucket and sweep, so a repeated task
    gives the same seating."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        b, rng = Bucket.read(row["pairs"], row["state"]), np.random.default_rng([5, row["bucket"], sweep])
        some = np.flatnonzero(b.counts > 1)
        is_hot = find(deal.hot, b.words)
        guests, theirs = b.by_word(b.tables()), b.theirs.copy()
        guests[is_hot[1]], theirs[is_hot[1]] = before.hot[1:, is_hot[0][is_hot[1]]]
        own = b.owners()[some]
        # the word's other customers in the parent, and the restaurant's other tables
        rest = np.maximum(guests[own] - b.drawn, 0)
        parent = before.parent(rest, np.minimum(theirs[own], rest))
        known = np.concatenate([np.zeros(0, np.int64), *[_wide(unpack(x)[0]) for x in right.sort_by("slot")["totals"].to_pylist()]])
        _, at = np.unique(b.contexts[some], return_inverse=True)
        b.drawn = reseat(b.counts[some], known[at] - b.drawn, parent, STRENGTH[0], DISCOUNT[0], rng)
        guests, cold = b.by_word(b.tables()), ~is_hot[1]
        b.theirs = np.zeros(len(b.words), np.int64)
        b.theirs[cold] = reseat(guests[cold], before.theirs - theirs[cold], np.full(cold.sum(), before.uniform()), STRENGTH[1], DISCOUNT[1], rng)
        blobs = {"pairs": row["pairs"], "state": pack(b.drawn, b.theirs), "before": row["state"], "hot": pack(is_hot[0][is_hot[1]], guests[is_hot[1]])}
        return pa.table({"bucket": pa.array([row["bucket"]], pa.int32())} | {k: pa.array([x], pa.binary()) for k, x in blobs.items()} | {"guests": [int(guests[cold].sum())], "theirs": [int(b.theirs.sum())]})

    now = now.select("bucket", "pairs", "state")
    return now.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(run, "bucket int, pairs binary, state binary, before binary, hot binary, guests long, theirs long")


def _hot_sums(values: DataFrame, deal: Deal, n: int) -> np.ndarray:
    """n sums for each hot word over the packed (places, values ...) of all buckets: at most HOT rows
    reach the driver."""
    names = [f"v{k}" for k in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict(dict(zip(["at", *names], map(_wide, unpack(raw)), strict=True)))

    out = np.zeros((n, len(deal.hot)), np.int64)
    if len(deal.hot):
        for r in values.mapInArrow(run, ", ".join(f"{c} long" for c in ["at", *names])).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).collect():
            out[:, r["at"]] = r[1:]
    return out


def _sizes(model: DataFrame, deal: Deal) -> DataFrame:
    """By bucket: tokens of all words, distinct words that aren't hot, and hot words' tokens and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("pairs").to_pylist():
                b = Bucket.read(raw, None)
                at, ok = find(deal.hot, b.words)
                yield pa.RecordBatch.from_pydict({"n": [int(b.counts.sum())], "v": [int((~ok).sum())], "hot": pa.array([pack(at[ok], b.by_word(b.counts)[ok], b.by_word(b.tables())[ok])], pa.binary())})

    return model.select("pairs").mapInArrow(run, "n long, v long, hot binary")


def fit(scratch: Scratch, model: DataFrame, deal: Deal) -> tuple[DataFrame, list[Totals]]:
    """The pairs of all buckets with the states of the kept sweeps (before, state), and those sweeps'
    totals. At first every pair has one table, and every word one in the parent."""
    sizes = scratch.save(_sizes(model, deal))
    r, (tokens_, guests) = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first(), _hot_sums(sizes.select("hot"), deal, 2)
    n, vocabulary = r.n, r.v + int((tokens_ > 0).sum())
    seen = [Totals(max(1, n // 2), max(1, vocabulary), vocabulary, n, np.stack([tokens_, guests, np.minimum(guests, 1)]))]
    now = model.withColumn("state", F.lit(None).cast("binary"))
    for k in range(SWEEPS):
        new = scratch.save(_sweep(now, _context_tables(now, deal), seen[-1], deal, k))
        scratch.drop(model if k == 0 else now)
        now = new
        sums = now.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("guests", "theirs")]).first()
        guests = _hot_sums(now.select("hot"), deal, 1)[0]
        uniform = np.full(len(guests), seen[-1].uniform())
        theirs = reseat(guests, seen[-1].theirs - seen[-1].hot[2], uniform, STRENGTH[1], DISCOUNT[1], np.random.default_rng([6, k]))
        theirs = np.minimum(theirs, guests)
        seen.append(Totals(sums.guests + int(guests.sum()), sums.theirs + int(theirs.sum()), vocabulary, n, np.stack([tokens_, guests, theirs])))
    return now, seen[-KEPT:]


# ---- scoring -----------------------------------------------------------------------------------


#: Columns of the kept sweeps' states.
KEPT_STATES = ("before", "state")


def context_table(rows: DataFrame, deal: Deal) -> DataFrame:
    """One row per slot: contexts in order, customers, and tables in each kept sweep."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seatings = [Bucket.read(row["pairs"], row[k]) for k in KEPT_STATES]
                b = seatings[0]
                found, at = np.unique(b.contexts, return_inverse=True)
                sums = [np.bincount(at, v, len(found)).astype(np.int64) for v in (b.counts, *[s.tables() for s in seatings])]
                edge = deal.slot_edges(found)
                full = np.flatnonzero(np.diff(edge))
                blobs = [pack(found[x], *[v[x] for v in sums]) for x in (slice(edge[s], edge[s + 1]) for s in full)]
                yield pa.RecordBatch.from_pydict({"slot": full.astype(np.int32), "sums": pa.array(blobs, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table["sums"].to_pylist()]
        found, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([_wide(p[k]) for p in parts]), len(found)).astype(np.int64) for k in range(1, 2 + KEPT)]
        return pa.table({"slot": table["slot"][:1], "sums": pa.array([pack(found, *sums)], pa.binary())})

    return rows.select("pairs", *KEPT_STATES).mapInArrow(send, "slot int, sums binary").groupBy("slot").applyInArrow(add, "slot int, sums binary")


def score(docs: DataFrame, rows: DataFrame, contexts: DataFrame, seen: list[Totals], deal: Deal) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row of docs.

    A chunk asks each bucket for its distinct pairs and their words, and each slot for its distinct
    contexts, once each, and keeps its tokens as numbers of its words; the answers meet in the chunk.
    """
    total, vocabulary = seen[-1].total, seen[-1].vocabulary
    places = deal.buckets + deal.slots

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in chunks(batches):
            chunk = (task << 32) | count
            count += 1
            word, first = tokens(*text_bytes(batch.column("text")))
            words, at, n = np.unique(word, return_inverse=True, return_counts=True)
            context = deal.contexts(word, first)
            bucket, w, c, _ = _distinct(deal, words, at, context)
            by_use = np.argsort(-n, kind="stable")  # small numbers for frequent words: they pack well
            number = np.empty(len(words), np.int64)
            number[by_use] = np.arange(len(words))
            full, start = np.unique(bucket, return_index=True)
            asked = [pack(*_runs(w[a:b]), c[a:b]) for a, b in zip(start, np.append(start[1:], len(w)), strict=True)]
            found = np.unique(context)
            edge = deal.slot_edges(found)
            slots = np.flatnonzero(np.diff(edge))
            asked += [pack(found[edge[s] : edge[s + 1]]) for s in slots]
            ids = batch.column("doc_id")
            home = pack(pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False).view(U), pa.compute.is_valid(ids).to_numpy(zero_copy_only=False), first, words[by_use], number[at])
            where = [chunk % places, *full.tolist(), *(deal.buckets + slots).tolist()]
            yield pa.RecordBatch.from_pydict({"place": pa.array(where, pa.int32()), "chunk": pa.array([chunk] * len(where), pa.int64()), "home": [True] + [False] * len(asked), "asked": pa.array([home, *asked], pa.binary())})

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0] if len(right) else {"pairs": None, "sums": None}
        if row["pairs"] is not None:
            seatings = [Bucket.read(row["pairs"], row[k]) for k in KEPT_STATES]
            b = seatings[0]
            keys = pair_keys(np.repeat(b.words, b.sizes), b.contexts)
            order = np.argsort(keys)
            keys, by_pair = keys[order], np.stack([b.counts, *[s.tables() for s in seatings]])[:, order]
            by_word = np.stack([b.by_word(b.counts), *[x for s in seatings for x in (s.by_word(s.tables()), s.theirs)]])
        elif row["sums"] is not None:
            known, *sums = unpack(row["sums"])
            by_context = np.stack([_wide(x) for x in sums])

        def values(table: np.ndarray, ordered: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
            at, ok = find(ordered, keys)
            return list(np.where(ok, table[:, at], 0))

        out = []
        for home, raw in zip(left["home"].to_pylist(), left["asked"].to_pylist(), strict=True):
            if home or row["pairs"] is None and row["sums"] is None:
                out.append(raw if home else None)
            elif row["sums"] is not None:
                out.append(pack(*values(by_context, known, unpack(raw)[0])))
            else:
                w, sizes, c = unpack(raw)
                out.append(pack(*values(by_pair, keys, pair_keys(np.repeat(w, sizes), c)), *values(by_word, b.words, w)))
        return pa.table({"chunk": left["chunk"], "place": left["place"], "home": left["home"], "answer": pa.array(out, pa.binary())})

    def close(table: pa.Table) -> pa.Table:
        got = table.filter(pa.compute.invert(table["home"]))
        answers = dict(zip(got["place"].to_pylist(), got["answer"].to_pylist(), strict=True))
        ids, valid, first, words, at = unpack(table.filter(table["home"])["answer"][0].as_py())
        first, order = _wide(first), np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words, at = words[order], place[at]
        word = words[at]
        context = deal.contexts(word, first)
        bucket, w, c, pair = _placed(deal, words, at, context)
        full, start = np.unique(bucket, return_index=True)
        by_pair, by_word = np.zeros((1 + KEPT, len(w)), np.int64), np.zeros((1 + 2 * KEPT, len(words)), np.int64)
        for p, a, b in zip(full.tolist(), start, np.append(start[1:], len(w)), strict=True):
            if answers[p] is not None:
                values = [_wide(x) for x in unpack(answers[p])]
                by_pair[:, a:b] = np.stack(values[: 1 + KEPT])
                by_word[:, np.searchsorted(words, _runs(w[a:b])[0])] = np.stack(values[1 + KEPT :])
        where, is_hot = find(deal.hot, words)
        for k, x in enumerate(seen):
            n, guests, theirs = x.hot[:, where[is_hot]] if len(deal.hot) else np.zeros((3, 0), np.int64)
            by_word[0, is_hot], by_word[1 + 2 * k, is_hot], by_word[2 + 2 * k, is_hot] = n, guests, theirs
        found, up = np.unique(context, return_inverse=True)
        edge, by_context = deal.slot_edges(found), np.zeros((1 + KEPT, len(found)), np.int64)
        for s in np.flatnonzero(np.diff(edge)).tolist():
            if answers[deal.buckets + s] is not None:
                by_context[:, edge[s] : edge[s + 1]] = np.stack([_wide(x) for x in unpack(answers[deal.buckets + s])])
        # pair, at and up are each token's place among the pairs, the words and the contexts
        customers, p = by_context[0], np.zeros(len(word))
        for k, x in enumerate(seen):
            own = by_pair[0] - DISCOUNT[0] * by_pair[1 + k]
            p += (own[pair] + weight(by_context[1 + k])[up] * x.parent(by_word[1 + 2 * k], by_word[2 + 2 * k])[at]) / (STRENGTH[0] + customers[up])
        n = by_word[0]
        base = np.log10((n + 1) / (total + 1 * (vocabulary + 1)))
        add = lambda x: np.add.reduceat(x, first[:-1])
        return pa.table({"doc_id": pa.array(ids.view(np.int64), mask=~valid), "n_tokens": np.diff(first), "n_known": add((n > 0).astype(np.int64)[at]), "base_score": add(base[at]), "score": add(np.log10(p / len(seen)))})

    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    by_bucket = rows.select(F.col("bucket").alias("place"), "pairs", *KEPT_STATES, *none("sums"))
    by_slot = contexts.select((F.col("slot") + deal.buckets).alias("place"), *none("pairs", *KEPT_STATES), "sums")
    sent = docs.mapInArrow(send, "place int, chunk long, home boolean, asked binary")
    back = sent.groupBy("place").cogroup(by_bucket.unionByName(by_slot).groupBy("place")).applyInArrow(look_up, "chunk long, place int, home boolean, answer binary")
    return back.groupBy("chunk").applyInArrow(close, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def language_model(docs: DataFrame, training: DataFrame) -> tuple[DataFrame, int]:
    """Scores of docs under a model of `training`, and the number of training tokens.

    Tokens: words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one end; null counts as empty, so
    it has the end only. All rows of training are counted. Without any, every token is unknown.
    Repeated rows, and rows without doc_id, count and are scored once each; very long texts are chunks
    of their own, handled whole. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    _, volume = text_volume(docs)
    training = bare(training, "text")
    deal = Deal(1 << max(4, int(max(1, volume // BUCKET)).bit_length()), hot_words(training))
    model = scratch.save(count_pairs(training, deal))
    rows, seen = fit(scratch, model, deal)
    contexts = scratch.save(context_table(rows, deal))
    docs, out = bare(docs, "text"), []
    for k in range(PARTS):
        some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS)) == k)
        out.append(scratch.save(score(some, rows, contexts, seen, deal)))
    scratch.drop(rows, contexts)
    scratch.tidy()
    return reduce(DataFrame.unionByName, out), seen[-1].total


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    scored, n = language_model(docs, docs.filter(remainder(7) != 2))
    return scored.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
