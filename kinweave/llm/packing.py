"""Best-fit packing with exact-complement hashing.

Tokens are counted per document on the executors. What the driver sees is only the histogram of
piece lengths (at most `size` numbers, whatever the input): patterns of lengths that fill a
sequence are chosen on it, then pieces get their places from their ranks within their length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import Scratch, bare, lower_ascii, pieces, text_bytes

#: Distinct words, or parts of words, whose ids one Python worker keeps; a full table starts afresh.
MEMO = 1_000_000
#: Words of Latin letters, with or without ASCII punctuation around them: each of the up to three
#: parts is one pre-token, whatever the normaliser does. "'" and "<" are left out (contractions and
#: special tokens); other words are encoded one by one.
PLAIN = r"^([!-&(-/:;=-@\[-`{-~]*)[A-Za-zÀ-ÖØ-öø-ÿ]+([!-&(-/:;=-@\[-`{-~]*)$"
#: What a byte is in a word whose parts can be told by bytes alone: 1 an ASCII letter, 2 such punctuation, else 0.
KIND = np.zeros(256, np.int8)
KIND[[c for c in range(128) if re.match(PLAIN, f"{chr(c)}a")]] = 2
KIND[[c for c in range(128) if chr(c).isalpha()]] = 1


def word_parts(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct strings whose ids in a row are those of the words; the strings of all words, by number;
    and n + 1 offsets into them by word.

    A word of ASCII letters with or without punctuation around them is its up to three pre-tokens, with
    small letters (the normaliser makes them so); any other word is left whole. "Word", "word" and "word,"
    have "word" in common, which is encoded and looked up once."""
    data, offsets = text_bytes(words)
    kind = KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = edge[:-1].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    letters = np.concatenate([[0], np.cumsum(starts & (kind == 1))])
    other = np.concatenate([[0], np.cumsum(kind == 0)])
    plain = (np.diff(letters[offsets]) == 1) & (np.diff(other[offsets]) == 0)
    inside = np.repeat(plain, np.diff(offsets))
    starts &= inside | edge[:-1]
    at = np.flatnonzero(starts)
    low = np.where(inside, lower_ascii(data), data)
    parts = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(low)]).dictionary_encode()
    return parts.dictionary, parts.indices.to_numpy(), np.searchsorted(at, offsets)


class WordEncoder:
    """Ids of whole texts, word by word.

    The tokenizer drops white space before it splits, and no rule of its normaliser or of its
    pre-tokenizer reaches over white space, so a text's ids are those of its words in a row. A batch
    is cut at ASCII white space, words are cut into their parts where bytes show them (`word_parts`), and
    each distinct part is encoded once, by the tokenizers library.
    """

    def __init__(self, path: str, memo: int = MEMO):
        # a task has one core: the library's own threads would spin, and keep memory, beside other tasks'
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.memo = memo
        self.last = np.zeros(1 + max(vocab.values()), bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> list[int]:
        """The numbers of words, after those not known yet have been encoded."""
        known = self.number
        got = list(map(known.get, words))
        new = [w for w, k in zip(words, got, strict=True) if k is None] if None in got else []
        if not new:
            return got
        if len(known) + len(new) > self.memo:
            self.clear()
            known, new = self.number, words
        step = max(1, self.memo // 32)  # the library's encodings take some hundred bytes a token
        parts = [self._encode_words(new[k : k + step]) for k in range(0, len(new), step)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        known |= zip(new, range(len(known), len(known) + len(new)), strict=True)
        end = self.first[-1]
        if end + len(ids) > len(self.ids):
            room = np.empty(2 * end + len(ids), np.uint32)  # pages not written to take no memory
            room[:end] = self.ids[:end]
            self.ids = room
        self.ids[end : end + len(ids)] = ids
        self.first = np.concatenate([self.first, end + np.cumsum(sizes)])
        return list(map(known.__getitem__, words))

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Plain words go to the tokenizer as one
        text: its ids are told apart by the tokens that end a pre-token."""
        column = pa.array(words, pa.large_string())
        parts = pc.extract_regex(column, pattern=PLAIN.replace("^(", "^(?P<a>").replace("+(", "+(?P<b>"))
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        n = np.ones(len(words), np.int64)
        for k in range(2):
            n += pc.fill_null(pc.greater(pc.binary_length(pc.struct_field(parts, k)), 0), False).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(plain)
        sizes = np.zeros(len(words), np.int64)
        flat = np.zeros(0, np.uint32)
        if len(at):
            text = " ".join(column.filter(pa.array(plain)).to_pylist())
            flat = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[flat]) + 1
            stop = np.cumsum(n[at])
            if len(ends) == stop[-1]:
                sizes[at] = np.diff(ends[stop - 1], prepend=0)
            else:
                plain[:], at, flat = False, at[:0], flat[:0]
        rest = np.flatnonzero(~plain)
        got = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)]
        sizes[rest] = [len(x) for x in got]
        source = np.concatenate([flat, np.fromiter((i for x in got for i in x), np.uint32)])
        first = np.zeros(len(words), np.int64)
        order = np.concatenate([at, rest])
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        total = np.cumsum(sizes) - sizes
        return source[np.arange(sizes.sum()) + np.repeat(first - total, sizes)], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and n + 1 offsets."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = lists.flatten().dictionary_encode()
        parts, of, edges = word_parts(words.dictionary)
        number = np.array(self._learn(parts.to_pylist()), np.int64)[of]
        ids, first = _gather(self.ids, self.first, number)  # of this batch's distinct words
        ids, total = _gather(ids, first[edges], words.indices.to_numpy(zero_copy_only=False))
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return ids, total[bounds]


def _gather(values: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[first[k]:first[k + 1]] for each k of `number`, in a row, and their n + 1 offsets."""
    sizes = np.diff(first)[number]
    total = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    return values[np.arange(total[-1]) + np.repeat(first[number] - total[:-1], sizes)], total


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, memo: int = MEMO) -> WordEncoder:
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = WordEncoder(path, memo)
    return _ENCODERS[path, memo]


# ---- the plan over the histogram of lengths ----------------------------------------------------


def _pairs(have: np.ndarray, twice: np.ndarray, total: int) -> tuple[int, int] | None:
    """Two lengths of which there is stock and that add up to `total`; the longest first."""
    if total < 2:
        return None
    low = np.arange(1, total // 2 + 1)
    ok = have[low] & have[total - low]
    if total % 2 == 0:
        ok[-1] = twice[total // 2]
    at = np.flatnonzero(ok)
    return (total - int(low[at[0]]), int(low[at[0]])) if len(at) else None


def plan_patterns(counts: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """[({length: pieces of it in the sequence}, sequences)], using counts[length] pieces in all.

    The longest length with stock opens a sequence. Its gap is filled exactly by one length, else by
    two or three (indexed by their sums), as many times as the stock allows; each such step uses up
    a length, so there are at most `size` of them. What finds no exact complement is best-fitted:
    the longest length that fits the gap, again and again.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []

    def use(lengths: list[int]) -> None:
        need = dict(zip(*np.unique(lengths, return_counts=True), strict=True))
        times = min(int(left[a]) // int(n) for a, n in need.items())
        for a, n in need.items():
            left[a] -= times * n
        out.append(({int(a): int(n) for a, n in need.items()}, times))

    if left[size]:
        use([size])
    rest = []  # lengths without an exact complement while they were the longest
    stock = np.zeros(size + 1, np.int64)
    for a in range(size - 1, 0, -1):
        while left[a]:
            gap = size - a
            have, twice = left > 0, left > 1
            have[a], twice[a] = left[a] > 1, left[a] > 2
            found = None
            if have[gap] and gap <= a:
                found = (gap,)
            else:
                found = _pairs(have, twice, gap)
                if not found and gap >= 3:
                    found = _triple(have, left - (np.arange(size + 1) == a), gap)
            if not found:
                stock[a], left[a] = left[a], 0
                rest.append(a)
                break
            use([a, *found])
    left = stock
    while rest:
        a = rest[0]
        if not left[a]:
            rest.pop(0)
            continue
        need, gap, k = {a: 1}, size - a, 0
        live = np.array(rest)
        while gap > 0:
            live = live[live <= gap]
            if not len(live):
                break
            b = int(live[0])
            free = int(left[b]) - need.get(b, 0)
            if free > 0:
                n = min(gap // b, free)
                need[b] = need.get(b, 0) + n
                gap -= n * b
            live = live[1:]
            k += 1
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= times * n
        out.append((need, times))
    return out


def _triple(have: np.ndarray, left: np.ndarray, gap: int) -> tuple[int, int, int] | None:
    """Three lengths adding up to gap: pair sums are counted by convolution, less the pairs that the
    stock doesn't allow beside the third length, so the longest candidate left has its pair."""
    have = have[: gap + 1]
    v = have.astype(np.float64)
    n = 1 << int(2 * gap + 1).bit_length()
    sums = np.rint(np.fft.irfft(np.fft.rfft(v, n) ** 2, n)[: gap + 1]).astype(np.int64)
    x = np.arange(gap // 2 + 1)
    sums[2 * x] -= have[x] & (left[x] < 2)  # one piece twice
    c = np.arange(1, gap - 1)
    c = c[have[c]]
    rest = gap - 2 * c  # with c itself in the pair
    pairs = sums[gap - c]
    pairs -= np.where((left[c] == 1) & (rest > 0) & (rest != c) & have[np.maximum(rest, 0)], 2, 0)
    pairs -= (left[c] == 2) & (rest == c)
    for c in c[pairs > 0][::-1]:
        stock = left.copy()
        stock[c] -= 1
        if found := _pairs(stock > 0, stock > 1, int(gap - c)):
            return (int(c), *found)
    return None


def plan_slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces of it in a sequence, place of the first, first sequence)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for need, times in patterns:
        place = 0
        for a in sorted(need, reverse=True):
            n = need[a]
            out.append((a, used.get(a, 0), used.get(a, 0) + n * times, n, place, sequence))
            used[a] = used.get(a, 0) + n * times
            place += n * a
        sequence += times
    return out


# ---- the operator ------------------------------------------------------------------------------

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def _cut(path: str, size: int, end_id: int, with_ids: bool, memo: int = MEMO):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in pieces(batches):
            ids, offsets = encoder(path, memo).encode(batch.column("text"))
            n = np.diff(offsets)
            out = np.insert(ids, offsets[1:], end_id).astype("<u4", copy=False)
            ends = np.cumsum(n + 1)
            parts = (n + size) // size  # ceil((n + 1) / size)
            row = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * size
            length = np.minimum(size, (n + 1)[row] - start)
            at = (ends - n - 1)[row] + start
            raw = memoryview(out).cast("B")
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered)
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - first + seen[ordered]
            seen += np.bincount(length, minlength=size + 1)
            got = {
                "doc_id": batch.column("doc_id").take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length,
                "ids_crc32": np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(row)),
                "task": np.full(len(row), task, np.int32), "rank": rank,
            }
            if with_ids:
                got["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(out)).astype(np.int32)), pa.array(out.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(got)

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = 4096, end_id: int = 1, with_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    `with_ids` the ids themselves.

    A document is its ids, then end_id; null counts as empty, so it is one piece of length 1. Only
    documents of more than `size` ids are cut. Pieces of equal length are interchangeable: each
    takes a rank within its length (its rank in its task plus what earlier tasks hold, a window over
    one row per task and length), and the plan, at most some thousand rows however large the input,
    gives the rank a sequence and a place. Repeated rows are packed once each; an empty table gives
    no rows. `memo` bounds the words whose ids a worker keeps: results are the same for any, less takes
    more time and less memory.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    path = path or public_tokenizers.path("word_bpe_49k.json")
    cut = scratch.save(bare(docs, "text").mapInArrow(_cut(path, size, end_id, with_ids, memo), _PIECES + ", ids array<int>" * with_ids))
    stock = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in stock.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[r.length] = r.n
    slots = spark.createDataFrame(plan_slots(plan_patterns(counts, size)), "length long, low long, high long, per long, place long, sequence long")
    before = stock.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.join(before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), ["length", "task"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    out = ranked.join(F.broadcast(slots), "length").filter("rank >= low and rank < high")
    k = F.col("rank") - F.col("low")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return out.select(*columns, (F.col("sequence") + F.floor(k / F.col("per"))).alias("sequence_id"), (F.col("place") + k % F.col("per") * F.col("length")).alias("offset"), *["ids"] * with_ids)
