"""Substring dedup by recompression.

A document is a sequence of word fingerprints. Rounds replace runs of one symbol and then pairs of
neighbours by new symbols; which pairs merge depends on the two symbols alone, and a new symbol's
name is a fingerprint of its parts, so all executors give equal strings equal names without a
dictionary. A round only touches symbols of at most so many words (restricted recompression), so
what stands more than MARGIN words before or after a place can't matter for the phrases there: two
equal windows have the same phrases, MARGIN words from their ends inwards. Phrases that occur once
rule out all windows around them; the windows left are named whole and compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import U, Scratch, bare, chain, mix, pieces, row_of, span_hashes, text_bytes, text_volume, word_spans
from kinweave.llm.exchange import buckets_for, exchange

WINDOW = 35


Rounds = tuple[tuple[str, int], ...]


def plan_rounds(window: int) -> tuple[Rounds, int]:
    """Rounds for windows of so many words, and their margin.

    A pair round of limit k joins neighbours of at most k words each: whether it does so at a place
    depends on k words to either side. A run round of limit k names runs of exactly two equal
    symbols (longer runs stay, so that a run's inside looks the same from everywhere); that depends
    on 2k words. Phrases have at most 2k words, and what the margins leave of a window must hold a
    whole one: window - 2 * margin >= 2 * 2k - 1.
    """
    out: list[tuple[str, int]] = []
    margin = 0
    for kind, k in (("run", 1), ("pair", 1), ("pair", 1), ("pair", 2), ("pair", 2), ("pair", 3), ("pair", 3), ("run", 4), ("pair", 4), ("pair", 4), ("pair", 6), ("pair", 6)):
        more = 2 * k if kind == "run" else k
        if window - 2 * (margin + more) < 4 * k - 1:
            break
        margin += more
        out.append((kind, k))
    return tuple(out), margin


def recompress(symbols: np.ndarray, rows: np.ndarray, rounds: Rounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top-level phrases: names, widths in words, rows. Nothing crosses a row."""
    name, width, row = symbols, np.ones(len(symbols), np.int64), rows
    for turn, (kind, limit) in enumerate(rounds, 1):
        if len(name) < 2:
            break
        may = width <= limit
        joins = (row[1:] == row[:-1]) & may[1:] & may[:-1]
        if kind == "run":
            equal = joins & (name[1:] == name[:-1])
            edge = np.concatenate([[False], equal, [False]])
            at = np.flatnonzero(equal & ~edge[:-2] & ~edge[2:])
        else:  # left symbols open a pair, right symbols close one: no place can be in two pairs
            side = (mix(name ^ U(turn * 0x632BE59BD9B4E019 % (1 << 64))) & U(1)).astype(bool)
            at = np.flatnonzero(joins & ~side[:-1] & side[1:])
        new, wide = name.copy(), width.copy()
        new[at] = mix(name[at] * U(0xD1342543DE82EF95) + mix(name[at + 1]) + U(turn))
        wide[at] += width[at + 1]
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, width, row = new[keep], wide[keep], row[keep]
    return name, width, row


def open_windows(starts: np.ndarray, widths: np.ndarray, shared: np.ndarray, n_words: int, window: int, margin: int) -> np.ndarray:
    """True for each window start of one document (n_words - window + 1 of them) whose inner phrases
    are all shared."""
    n = n_words - window + 1
    if n <= 0:
        return np.zeros(0, bool)
    lone = ~shared
    # a phrase [s, e) lies inside window i if i + margin <= s and e <= i + window - margin
    low = np.clip(starts[lone] + widths[lone] - (window - margin), 0, n)
    high = np.clip(starts[lone] - margin + 1, 0, n)
    ok = high > low
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, low[ok], 1)
    np.add.at(step, high[ok], -1)
    return np.cumsum(step[:n]) == 0


def _runs(flags: np.ndarray) -> np.ndarray:
    """[start, end, start, end ...) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge.astype(np.int32)


def _spread(runs: np.ndarray) -> np.ndarray:
    """Positions in the runs."""
    size = runs[1::2] - runs[::2]
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(runs[::2], size)


def _ids(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    ids = batch.column("doc_id")
    return {"doc_id": pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False), "known": pa.compute.is_valid(ids).to_numpy(zero_copy_only=False), "key": batch.column("key").to_numpy()}


def _id_columns(home: dict[str, bytes]) -> dict[str, pa.Array]:
    known = np.frombuffer(home["known"], bool)
    return {"doc_id": pa.array(np.frombuffer(home["doc_id"], np.int64), mask=~known), "key": pa.array(np.frombuffer(home["key"], np.int64))}


def kept_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray | None = None) -> tuple[list[str], list[str]]:
    """Of each row, the kept words joined by one space, and their SHA-256."""
    raw, texts, out = data.tobytes(), [], []
    a, b = starts.tolist(), ends.tolist()
    for r in range(len(first) - 1):
        span = range(first[r], first[r + 1]) if keep is None else (np.flatnonzero(keep[first[r] : first[r + 1]]) + first[r]).tolist()
        text = b" ".join([raw[a[k] : b[k]] for k in span])
        texts.append(text)
        out.append(hashlib.sha256(text).hexdigest())
    return texts, out


def joined_digests(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """SHA-256 of all words of each row, joined by one space."""
    raw, cut = data.tobytes(), offsets.tolist()
    return [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _phrases(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """By document: n_words, kept_sha256 if nothing goes, and the runs of windows still open."""
    rounds, margin = plan_rounds(window)

    def keys_of(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_spans(data, offsets)
        words, row = span_hashes(data, starts, ends), row_of(first)
        name, width, of = recompress(words, row, rounds)
        home = _ids(batch) | {"n_words": np.diff(first), "width": width.astype(np.uint8), "n": np.bincount(of, minlength=batch.num_rows), "sha": np.array(joined_digests(data, offsets), "S64")}
        return name, of, np.arange(len(name)), home

    def answer(home: dict[str, bytes], tags: np.ndarray) -> pa.Table:
        n_words, n = np.frombuffer(home["n_words"], np.int64), np.frombuffer(home["n"], np.int64)
        width = np.frombuffer(home["width"], np.uint8).astype(np.int64)
        shared = np.zeros(len(width), bool)
        shared[tags] = True
        edge = np.concatenate([[0], np.cumsum(n)])
        at = np.cumsum(width) - width
        out: list[bytes | None] = []
        for r in range(len(n)):
            a, b = edge[r], edge[r + 1]
            if n_words[r] < window:
                out.append(None)
                continue
            runs = _runs(open_windows(at[a:b] - at[a], width[a:b], shared[a:b], int(n_words[r]), window, margin))
            out.append(runs.tobytes() if len(runs) else None)
        sha = [x.decode() for x in np.frombuffer(home["sha"], "S64").tolist()]
        return pa.table(_id_columns(home) | {"n_words": n_words, "full_sha256": pa.array(sha, pa.string()), "runs": pa.array(out, pa.binary())})

    return exchange(docs, buckets, keys_of, answer, "doc_id long, key long, n_words long, full_sha256 string, runs binary", across_rows=False, exact=False)


def _windows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """By document: runs of words that windows cover whose words also start elsewhere."""

    def keys_of(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = word_spans(data, offsets)
        names = chain(span_hashes(data, starts, ends), window)
        runs = [np.frombuffer(x, np.int32) for x in batch.column("runs").to_pylist()]
        at = [_spread(r) for r in runs]
        n = np.array([len(x) for x in at], np.int64)
        place = np.concatenate([x + first[r] for r, x in enumerate(at)] or [np.zeros(0, np.int64)])
        home = _ids(batch) | {"n": n, "n_words": np.diff(first), "at": np.concatenate(at or [np.zeros(0)]).astype(np.int32)}
        return names[place], np.repeat(np.arange(len(n)), n), np.arange(len(place)), home

    def answer(home: dict[str, bytes], tags: np.ndarray) -> pa.Table:
        n, n_words, at = np.frombuffer(home["n"], np.int64), np.frombuffer(home["n_words"], np.int64), np.frombuffer(home["at"], np.int32)
        shared = np.zeros(len(at), bool)
        shared[tags] = True
        edge, out = np.concatenate([[0], np.cumsum(n)]), []
        for r in range(len(n)):
            hit = at[edge[r] : edge[r + 1]][shared[edge[r] : edge[r + 1]]]
            step = np.zeros(n_words[r] + 1, np.int64)
            step[hit] += 1
            step[hit + window] -= 1
            out.append(_runs(np.cumsum(step[:-1]) > 0).tobytes() if len(hit) else None)
        return pa.table(_id_columns(home) | {"covered": pa.array(out, pa.binary())})

    return exchange(docs, buckets, keys_of, answer, "doc_id long, key long, covered binary", across_rows=False, exact=True)


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with `with_text` the kept
    words joined by one space.

    Words are [^\\x20\\x09-\\x0D]+, unchanged; null has none. Every word goes that a window of `window`
    words covers whose sequence also starts anywhere else, in this document or another; windows are
    judged on the input. Names are 64-bit fingerprints of word fingerprints, alike on all executors.
    Rows that repeat a document are documents of their own, so their windows are repeats. Extra
    columns are ignored; an empty table gives no rows.
    """
    if window < 8:
        raise ValueError("recompression needs windows of 8 words or more")
    scratch = Scratch(docs.sparkSession, "substring")
    docs = bare(docs, "text").withColumn("key", F.xxhash64("doc_id", "text"))
    _, volume = text_volume(docs)
    every = scratch.save(_phrases(docs, window, buckets_for(volume)))
    same = lambda a, b: (a["key"] == b["key"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    open_ = every.filter("runs is not null").groupBy("doc_id", "key").agg(F.first("runs").alias("runs"))
    left = scratch.save(docs.join(open_, same(docs, open_)).select(docs.doc_id, docs.key, "text", "runs"))
    found = _windows(left, window, buckets_for(volume)).filter("covered is not null")
    found = scratch.save(found.groupBy("doc_id", "key").agg(F.first("covered").alias("covered")))

    scratch.tidy()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, first = word_spans(data, offsets)
            keep = np.ones(len(starts), bool)
            for r, x in enumerate(batch.column("covered").to_pylist()):
                if x:
                    keep[first[r] + _spread(np.frombuffer(x, np.int32))] = False
            texts, sha = kept_digests(data, starts, ends, first, keep)
            gone = np.array([(~keep[a:b]).sum() for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_removed": gone, "new_sha256": sha} | ({"kept_text": pa.array(texts, pa.binary()).cast(pa.string())} if with_text else {}))

    more = ", kept_text string" * with_text
    if with_text:  # every text is rewritten
        hit = docs.join(found, same(docs, found), "left").select(docs.doc_id, docs.key, "text", "covered")
    else:
        once = left.dropDuplicates(["doc_id", "key"])
        hit = once.join(found, same(once, found)).select(once.doc_id, once.key, "text", "covered")
    done = hit.mapInArrow(cut, "doc_id long, key long, n_removed long, new_sha256 string" + more)
    done = done.dropDuplicates(["doc_id", "key"]) if with_text else done
    out = every.join(done, same(every, done), "left")
    return out.select(every.doc_id, "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("new_sha256", "full_sha256").alias("kept_sha256"), *["kept_text"] * with_text)
