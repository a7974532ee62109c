"""Suffix-array dedup with difference covers.

Suffixes are dealt into buckets so that any two with the same first 50 bytes meet: each 50-byte
string is dealt by its anchor, the 24-byte substring in it with the smallest fingerprint. Anchors
that only one document has are settled by an exchange of fingerprints and drop out. The others go to
their bucket with the bytes around them, equal surroundings once per chunk. A bucket sorts its
suffixes by the difference cover modulo 3: sampled suffixes by triples of 8-byte letters, then by
pairs of the triples' names, the remaining ones through the next sampled suffix; equal 50-byte
prefixes then stand side by side, and the smallest doc_id of each run decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import U, Scratch, bare, mix, pieces, release, row_hashes, row_of, text_bytes, text_volume
from kinweave.llm.common import letters as byte_letters
from kinweave.llm.exchange import buckets_for, exchange

#: Bytes of a match, bytes of an anchor, windows of a match around one anchor.
MATCH, ANCHOR = 50, 24
REACH = MATCH - ANCHOR
#: Bytes around an anchor that its windows cover.
AROUND = REACH + MATCH
CHUNK = 1 << 20
#: Surroundings sorted at a time within a bucket (more if one anchor has more).
SLICE = 4_000
#: Surroundings are compared in so many parts, told apart by the anchor's hash, one after the other: what
#: one part sends is given back before the next.
PARTS = 2
#: Anchors with about so many different surroundings are compared window by window, outside the buckets.
HOT = 16_000


def _owners(h: np.ndarray) -> np.ndarray:
    """The place of the anchor of the MATCH bytes from each place on; h holds all ANCHOR-byte hashes."""
    best, place, have = h, np.arange(len(h), dtype=np.int32), 1
    while have < REACH + 1:  # the least of ever more neighbours, the left one of equals
        step = min(have, REACH + 1 - have)
        later = best[step:] < best[: len(best) - step]
        place = np.where(later, place[step:], place[: len(place) - step])
        best = np.where(later, best[step:], best[: len(best) - step])
        have += step
    return place


def _inside(offsets: np.ndarray) -> np.ndarray:
    """Which MATCH bytes lie in one row."""
    row = row_of(offsets)
    return row[: len(row) - MATCH + 1] == row[MATCH - 1 :]


def anchor_hashes(data: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Hashes of the ANCHOR bytes from each place, or from the places `at`, on. They place and filter
    strings and never decide."""
    w, n = byte_letters(data), len(data) - ANCHOR + 1
    out = w[:n][at] * U(0x9E3779B97F4A7C15)
    for k in (8, 16):
        out ^= out >> U(29)
        out += w[k : n + k][at]
        out *= U(0xBF58476D1CE4E5B9)
    return mix(out)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in order, and their fingerprints."""
    n = len(data)
    if n < MATCH:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = anchor_hashes(data)
    chosen = np.zeros(n, bool)
    chosen[_owners(h)[_inside(offsets)]] = True
    found = np.flatnonzero(chosen)
    return found, h[found]


def letters(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian letter; the text is padded with zeros."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U)
    out = np.zeros(len(text), U)
    for k in range(8):
        out = (out << U(8)) | padded[k : k + len(text)]
    return out


def ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of keys, the first key leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def smallest(text: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each start, the smallest owner of a start with the same MATCH bytes.

    Difference cover {1, 2} modulo 3: sampled places are sorted by three letters (24 bytes), their
    names by pairs 24 bytes apart (48 bytes) and the last two bytes. A place that isn't sampled is
    compared with one of residue 1 through the suffixes one byte on, and with one of residue 2
    through those two bytes on, which are sampled in either case.
    """
    n = len(text)
    wanted = np.zeros(n + MATCH, bool)
    for shift in (0, 1, 2):
        wanted[starts + shift] = True
    deep = wanted.copy()
    deep[24:] |= wanted[:-24]
    at = np.flatnonzero(deep[:n])
    at = at[at % 3 != 0]
    w = np.concatenate([letters(text), np.zeros(MATCH, U)])
    name = np.zeros(n + MATCH, np.int64)
    name[at] = 1 + ranks(w[at], w[at + 8], w[at + 16])
    sampled = np.flatnonzero(wanted[:n])
    sampled = sampled[sampled % 3 != 0]
    long = np.zeros(n + MATCH, np.int64)
    size = n + 2
    long[sampled] = 1 + ranks(name[sampled] * size + name[sampled + 24])
    b = np.concatenate([text, np.zeros(MATCH, np.uint8)]).astype(np.int64)
    best = owner.copy()

    def meet(residues: tuple[int, int], key) -> None:
        mine = np.flatnonzero((starts % 3 == residues[0]) | (starts % 3 == residues[1]))
        k = key(starts[mine])
        order = np.argsort(k, kind="stable")
        s = k[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        if len(s):
            least = np.minimum.reduceat(owner[mine][order], np.flatnonzero(new))
            out = np.empty(len(s), owner.dtype)
            out[order] = least[np.cumsum(new) - 1]
            best[mine] = np.minimum(best[mine], out)

    meet((1, 2), lambda p: (long[p] << 16) | (b[p + 48] << 8) | b[p + 49])
    meet((0, 1), lambda p: (b[p] << 48) | (long[p + 1] << 8) | b[p + 49])
    meet((0, 2), lambda p: (b[p] << 56) ^ (b[p + 1] << 48) | long[p + 2])
    return best


def _ids(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {"doc_id": batch.column("doc_id").to_numpy(zero_copy_only=False), "key": batch.column("key").to_numpy()}


def _shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """By document: n_bytes, the digest of the whole text, and places of anchors others have too."""

    def keys_of(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        at, h = anchors(data, offsets)
        row = np.searchsorted(offsets, at, "right") - 1
        local = at - offsets[row]
        gap = local - np.concatenate([[0], np.where(row[1:] == row[:-1], local[:-1], 0)]) if len(at) else local
        raw = data.tobytes()
        sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        home = _ids(batch) | {"gap": gap.astype(np.uint8), "n": np.bincount(row, minlength=batch.num_rows), "n_bytes": np.diff(offsets), "sha": np.array(sha, "S64")}
        return h, row, np.arange(len(at)), home

    def answer(home: dict[str, bytes], tags: np.ndarray) -> pa.Table:
        n, gap = np.frombuffer(home["n"], np.int64), np.frombuffer(home["gap"], np.uint8).astype(np.int64)
        shared = np.zeros(len(gap), bool)
        shared[tags] = True
        edge = np.concatenate([[0], np.cumsum(n)])
        out = []
        for r in range(len(n)):
            a, b = edge[r], edge[r + 1]
            hit = np.cumsum(gap[a:b])[shared[a:b]].astype(np.int32)
            out.append(hit.tobytes() if len(hit) else None)
        sha = [x.decode() for x in np.frombuffer(home["sha"], "S64").tolist()]
        return pa.table({"doc_id": np.frombuffer(home["doc_id"], np.int64), "key": np.frombuffer(home["key"], np.int64), "n_bytes": np.frombuffer(home["n_bytes"], np.int64), "full_sha256": pa.array(sha, pa.string()), "anchors": pa.array(out, pa.binary())})

    return exchange(docs, buckets, keys_of, answer, "doc_id long, key long, n_bytes long, full_sha256 string, anchors binary", across_rows=True, exact=False, chunk_bytes=CHUNK)


def _all_windows(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A mask of the window offsets that lie in the document."""
    low, end = REACH - before.astype(np.int64), np.maximum(after.astype(np.int64) + REACH - MATCH + 1, 0)
    one = np.int64(1)
    return np.where(end > low, (one << end) - (one << np.minimum(low, end)), 0).astype(np.uint32)


def _runs(covered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).astype(np.int32)


def _changes(order: np.ndarray, key: np.ndarray, own: np.ndarray, around: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which surroundings, in this order, differ from the one before. Hashes bring equal ones together;
    their bytes decide."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = (key[order][1:] != key[order][:-1]) | (own[order][1:] != own[order][:-1])
        a, b = order[:-1][~new[1:]], order[1:][~new[1:]]
        new[1:][~new[1:]] = (around[a] != around[b]).any(axis=1) | (before[a] != before[b]) | (after[a] != after[b])
    return new


def compare_surroundings(key: np.ndarray, around: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each surrounding (AROUND bytes with the anchor at REACH; `before` and `after` bytes of it
    are the document's), a mask of window offsets whose string also stands in a smaller document."""
    m = len(key)
    mask = np.zeros(m, np.uint32)
    if not m:
        return mask
    own = row_hashes(around, 0, AROUND) ^ mix(before.astype(U) << U(8) | after.astype(U))
    order = np.lexsort((doc, own, key))
    k, d = key[order], doc[order]
    new = _changes(order, key, own, around, before, after)
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    # window offsets that lie in the document
    low, high = REACH - before.astype(np.int64), after.astype(np.int64) + REACH - MATCH
    whole = _all_windows(before, after)
    mask[order] = np.where(d > d[first][group], whole[order], 0)
    # one of each surrounding is left; it can match another only over one of two half strings
    u = order[first]
    hope = np.zeros(len(u), bool)
    for a, b in ((REACH // 2, MATCH), (REACH, MATCH + REACH // 2)):
        x = row_hashes(around[u], a, b)
        by = np.argsort(x)
        s = x[by]
        twin = np.zeros(len(u), bool)
        twin[1:] = s[1:] == s[:-1]
        twin[:-1] |= twin[1:].copy()
        hope[by] |= twin
    u = u[hope]
    ku = key[u]
    bounds = np.append(np.flatnonzero(np.concatenate([[True], ku[1:] != ku[:-1]])), len(u)) if len(u) else np.zeros(1, int)
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SLICE, "right")) - 1)
        part = u[bounds[a] : bounds[b]]
        text = np.ascontiguousarray(around[part]).reshape(-1)
        offset = np.arange(REACH + 1)
        ok = (offset >= low[part][:, None]) & (offset <= high[part][:, None])
        which, off = np.nonzero(ok)
        best = smallest(text, which * AROUND + off, doc[part][which])
        hit = best < doc[part][which]
        got = np.zeros(len(part), np.int64)
        np.bitwise_or.at(got, which[hit], np.int64(1) << off[hit])
        mask[part] |= got.astype(np.uint32)
        a = b
    # surroundings equal to a smaller document's are wholly covered; those equal within one document
    # share its mask
    lead = mask[order[first]][group]
    same = d == d[first][group]
    mask[order] |= np.where(same, lead, 0).astype(np.uint32)
    return mask


# ---- anchors with many surroundings ------------------------------------------------------------


def _surroundings(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """AROUND bytes about each anchor, zeros outside its row, and how many before and from it are the row's."""
    padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(MATCH, np.uint8)])
    before = np.minimum(at - offsets[row], REACH)
    after = np.minimum(offsets[row + 1] - at, MATCH)
    around = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[at]
    edge = np.flatnonzero((before < REACH) | (after < MATCH))
    span = np.arange(AROUND) - REACH
    around[edge] *= (span >= -before[edge, None]) & (span < after[edge, None])
    return around, before, after


def hot_anchors(docs: DataFrame, hot: int, sample: int) -> np.ndarray:
    """Anchors, in order, that have about `hot` or more different surroundings: counted on one text in
    `sample`, those with half of it there or more. The choice changes where windows are compared, never
    a result. At most some hundred thousand for 30 GB of text, as each has thousands of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK):
            data, offsets = text_bytes(batch.column("text"))
            at, key = anchors(data, offsets)
            row = np.searchsorted(offsets, at, "right") - 1
            around, before, after = _surroundings(data, offsets, at, row)
            own = row_hashes(around, 0, AROUND) ^ mix(before.astype(U) << U(8) | after.astype(U))
            both = np.unique(np.stack([key, own], axis=1), axis=0) if len(key) else np.zeros((0, 2), U)
            yield pa.RecordBatch.from_pydict({"anchor": both[:, 0].view(np.int64) if len(both) else np.zeros(0, np.int64), "own": np.ascontiguousarray(both[:, 1]).view(np.int64)})

    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(sample)) == 0).select("text")
    each = some.mapInArrow(run, "anchor long, own long").distinct()
    found = each.groupBy("anchor").count().filter(F.col("count") * 2 * sample >= hot).select("anchor").toArrow()
    return np.sort(found["anchor"].to_numpy().view(U))


def _is_in(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(keys), bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def _hot_windows(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """One row for each window whose anchor is hot: a 128-bit digest of its bytes, doc_id, key and place."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK):
            data, offsets = text_bytes(batch.column("text"))
            if len(data) < MATCH:
                continue
            h = anchor_hashes(data)
            at = np.flatnonzero(_inside(offsets))
            at = at[_is_in(h, shared.value)[_owners(h)[at]]]
            row = np.searchsorted(offsets, at, "right") - 1
            raw, ids = data.tobytes(), _ids(batch)
            digest = [hashlib.blake2b(raw[a : a + MATCH], digest_size=16).digest() for a in at.tolist()]
            yield pa.RecordBatch.from_pydict({"window": pa.array(digest, pa.binary()), "doc_id": ids["doc_id"][row], "key": ids["key"][row], "place": (at - offsets[row]).astype(np.int32)})

    return docs.select("doc_id", "key", "text").mapInArrow(run, "window binary, doc_id long, key long, place int")


def _hot_places(windows: DataFrame) -> DataFrame:
    """By document: places of windows that a smaller document has too. The smallest doc_id is found
    by an aggregation with partial sums in the map tasks, so no group holds a window's documents."""
    least = windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("window", "least")
    return windows.join(least, "window").filter("doc_id > least").groupBy("doc_id", "key").agg(F.collect_set("place").alias("places"))


def _covered(docs: DataFrame, buckets: int, hot: np.ndarray, part: int) -> DataFrame:
    """By document with anchors: runs of bytes that go for the windows of anchors of a part that aren't hot."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    shift = U(64 - int(buckets).bit_length() + 1)
    wire = "bucket int, chunk long, home list, docs binary, edges binary, around binary".replace("home list", "home array<binary>")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, CHUNK):
            chunk = (task << 32) | number
            number += 1
            data, offsets = text_bytes(batch.column("text"))
            ids = _ids(batch)
            places = [np.frombuffer(x, np.int32) for x in batch.column("anchors").to_pylist()]
            n = np.array([len(x) for x in places], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            local = np.concatenate(places).astype(np.int64)
            at = local + offsets[row]
            key = anchor_hashes(data, at)
            cold = ~_is_in(key, shared.value) & (key % U(PARTS) == U(part))
            row, local, at, key = row[cold], local[cold], at[cold], key[cold]
            n = np.bincount(row, minlength=len(n))
            around, before, after = _surroundings(data, offsets, at, row)
            doc = ids["doc_id"][row]
            own = row_hashes(around, 0, AROUND) ^ mix(before.astype(U) << U(8) | after.astype(U))
            order = np.lexsort((doc, own, key))
            new = _changes(order, key, own, around, before, after)
            first = order[np.flatnonzero(new)]
            unique = np.empty(len(key), np.int64)
            unique[order] = np.cumsum(new) - 1
            bucket = (key[first] >> shift).astype(np.int64)
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edge))
            home = [ids["doc_id"].tobytes(), ids["key"].tobytes(), np.diff(offsets).tobytes(), n.tobytes(), local.astype(np.int32).tobytes(), unique.astype(np.uint32).tobytes(), doc[first].tobytes(), before.astype(np.uint8).tobytes(), after.astype(np.uint8).tobytes()]
            cut = lambda x: pa.array([None] + [x[first[edge[b] : edge[b + 1]]].tobytes() for b in full], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([chunk % buckets, *full.tolist()], pa.int32()), "chunk": pa.array([chunk] * (len(full) + 1), pa.int64()), "home": pa.array([home] + [None] * len(full), pa.list_(pa.binary())),
                    "docs": cut(doc), "edges": cut(np.stack([before, after], axis=1).astype(np.uint8)), "around": cut(around),
                }
            )

    def compare(table: pa.Table) -> pa.Table:
        release()
        homes, sent = table.filter(pa.compute.is_valid(table["home"])), table.filter(pa.compute.is_valid(table["docs"]))
        raw = sent["docs"].to_pylist()
        get = lambda n, t: np.frombuffer(b"".join(sent[n].to_pylist()), t)
        edges = get("edges", np.uint8).reshape(-1, 2)
        around = get("around", np.uint8).reshape(-1, AROUND)
        mask = compare_surroundings(row_hashes(around, REACH, MATCH), around, edges[:, 0], edges[:, 1], get("docs", np.int64))
        ends = np.cumsum([len(x) // 8 for x in raw]).astype(np.int64)
        return pa.table(
            {
                "chunk": pa.array(homes["chunk"].to_pylist() + sent["chunk"].to_pylist(), pa.int64()), "bucket": pa.array([-1] * len(homes) + sent["bucket"].to_pylist(), pa.int32()),
                "home": pa.array(homes["home"].to_pylist() + [None] * len(sent), pa.list_(pa.binary())),
                "mask": pa.array([None] * len(homes) + [mask[b - len(x) // 8 : b].tobytes() for b, x in zip(ends.tolist(), raw, strict=True)], pa.binary()),
            }
        )

    def close(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        raw = next(x for x in table["home"].to_pylist() if x is not None)
        types = (np.int64, np.int64, np.int64, np.int64, np.int32, np.uint32, np.int64, np.uint8, np.uint8)
        ids, key, size, n, local, unique, lead, before, after = (np.frombuffer(x, t) for x, t in zip(raw, types, strict=True))
        mask = np.frombuffer(b"".join(x for x in table["mask"].to_pylist() if x is not None), np.uint32)
        row = np.repeat(np.arange(len(n)), n)
        whole = _all_windows(before, after)
        mine = np.where(ids[row] > lead[unique], whole, mask[unique])
        base = np.cumsum(size) - size
        step = np.zeros(int(size.sum()) + 1, np.int32)
        for o in range(REACH + 1):
            hit = np.flatnonzero((mine >> np.uint32(o)) & np.uint32(1))
            start = base[row[hit]] + local[hit] - REACH + o
            np.add.at(step, start, 1)
            np.add.at(step, start + MATCH, -1)
        gone = np.cumsum(step[:-1]) > 0
        out = [_runs(gone[a : a + s]) for a, s in zip(base.tolist(), size.tolist(), strict=True)]
        return pa.table({"doc_id": ids, "key": key, "covered": pa.array([x.tobytes() if len(x) else None for x in out], pa.binary())})

    back = docs.mapInArrow(send, wire).groupBy("bucket").applyInArrow(compare, "chunk long, bucket int, home array<binary>, mask binary")
    return back.groupBy("chunk").applyInArrow(close, "doc_id long, key long, covered binary")


def suffix_dedup(docs: DataFrame, with_text: bool = True, hot: int = HOT, sample: int = 16) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `with_text`
    the kept bytes and the spans as (start, end).

    A text is its UTF-8 bytes; null counts as empty. Every byte goes that a 50-byte string covers
    which also starts in a document with a smaller doc_id; strings are judged on the input. Rows that
    repeat a doc_id never count as smaller than each other. Rows without doc_id come back as they are
    and take no part. Very long texts are handled whole. Extra columns are ignored; an empty table gives
    no rows. Windows of anchors with
    about `hot` different surroundings (see hot_anchors) are compared row by row, all others in buckets.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = bare(docs, "text").withColumn("key", F.xxhash64("doc_id", "text"))
    _, volume = text_volume(docs)
    some = docs.filter("doc_id is not null")
    every = scratch.save(_shared_anchors(some, buckets_for(2 * volume)))
    anchored = every.filter("anchors is not null").select("doc_id", "key", "anchors").dropDuplicates(["doc_id", "key"])
    left = scratch.save(some.join(anchored, ["doc_id", "key"]))
    many = hot_anchors(some, hot, sample)
    parts = [scratch.save(_covered(left, 4 * buckets_for(2 * volume), many, k).filter("covered is not null").dropDuplicates(["doc_id", "key"])) for k in range(PARTS)]
    scratch.drop(left)
    found = scratch.save(reduce(DataFrame.unionByName, parts).groupBy("doc_id", "key").agg(F.collect_list("covered").alias("covered")))
    del left
    if len(many):
        places = scratch.save(_hot_places(scratch.save(_hot_windows(some, many))))
        found = found.join(places, ["doc_id", "key"], "full")
    else:
        found = found.withColumn("places", F.lit(None).cast("array<int>"))

    scratch.tidy()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_bytes(batch.column("text"))
            kept, spans = [], []
            for r, (x, more) in enumerate(zip(batch.column("covered").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                runs, places = np.frombuffer(b"".join(x or []), np.int32), np.array(more or [], np.int64)
                step = np.zeros(offsets[r + 1] - offsets[r] + 1, np.int32)
                np.add.at(step, np.concatenate([runs[::2], places]), 1)
                np.add.at(step, np.concatenate([runs[1::2], places + MATCH]), -1)
                gone = np.cumsum(step[:-1]) > 0
                kept.append(data[offsets[r] : offsets[r + 1]][~gone].tobytes())
                spans.append(_runs(gone))
            size = np.diff(offsets)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_removed": size - np.array([len(x) for x in kept], np.int64), "n_spans": np.array([len(x) // 2 for x in spans], np.int64), "new_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
                | ({"kept": pa.array(kept, pa.binary()), "spans": pa.array([[{"start": a, "end": b} for a, b in zip(x[::2].tolist(), x[1::2].tolist(), strict=True)] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))} if with_text else {})
            )

    more = ", kept binary, spans array<struct<start:int,end:int>>" * with_text
    hit = some.join(found, ["doc_id", "key"], "left" if with_text else "inner").select("doc_id", "key", "text", "covered", "places")
    done = hit.dropDuplicates(["doc_id", "key"]) if with_text else hit
    done = done.mapInArrow(cut, "doc_id long, key long, n_removed long, n_spans long, new_sha256 string" + more)
    done = done if with_text else done.dropDuplicates(["doc_id", "key"])
    extra = ["kept", "spans"] * with_text
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = every.join(done, ["doc_id", "key"], "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("new_sha256", "full_sha256").alias("kept_sha256"), *extra)
    lost = docs.filter("doc_id is null").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), *([F.coalesce("text", F.lit("")).cast("binary").alias("kept"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")] if with_text else []))
    return out.unionByName(lost)
