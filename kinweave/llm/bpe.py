"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

The merge list fixes how far to the right the text can matter for a token (its sufficient
lookahead). A stream is read through a window of fixed size; the tokens of the window that end at
least the lookahead before the window's end can't change any more and are emitted. Streams (the
pre-tokens of a batch) advance side by side in numpy, so a window step costs no Python per stream.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from kinweave.llm.common import U, bare, pieces

#: Fixed value: the published pre-tokenizer pattern of byte-level BPE.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Distinct short pre-tokens whose ids one Python worker keeps; a full table starts afresh.
MEMO = 300_000
#: Pre-tokens of up to so many bytes are kept in the table.
SHORT = 48
#: Characters of a text that are split into pre-tokens at a time.
BLOCK = 1 << 16
#: A pre-token that ends so many characters before a block's end is final: the pattern looks at no more
#: than two characters beyond a token.
AHEAD = 3
#: Pre-tokens that are encoded at a time.
TOKENS = 1 << 17


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1
    bytes stand for themselves, the others for letters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Transducer:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, letters = file["model"]["vocab"], byte_letters()
        number = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(number[c] for c in token) if all(c in number for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.lookahead = self._lookahead(left, right, made)
        self.window = 2 * self.lookahead + 2 * max(map(len, self.bytes_of))
        self._index(left * size + right, made)
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.first = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def _lookahead(self, left, right, made) -> int:
        """Bytes to the right of a token that can still decide about it.

        A merge (a, b) fails only if an earlier merge takes b together with what follows it, or
        takes a's or b's own last part; so, in merge order, need(ab) = max(need(b), the most that
        len(c) + need(bc) comes to over earlier merges (b, c)). Single bytes need nothing.
        """
        need = [0] * len(self.bytes_of)
        taken = [0] * len(self.bytes_of)  # by left part: max of len(c) + need over merges so far
        for a, b, ab in zip(left.tolist(), right.tolist(), made.tolist(), strict=True):
            need[ab] = max(need[ab], need[b], taken[b])
            taken[a] = max(taken[a], len(self.bytes_of[b]) + need[ab])
        return max(max(need), max(taken))

    def _index(self, pairs: np.ndarray, made: np.ndarray) -> None:
        """An open hash table of pairs: slot -> pair, rank, made."""
        bits = int(len(pairs) * 4).bit_length()
        self.shift = U(64 - bits)
        self.pair = np.full((1 << bits) + 64, -1, np.int64)
        self.rank = np.full((1 << bits) + 64, len(pairs), np.int64)
        self.made = np.zeros((1 << bits) + 64, np.int64)
        slot, todo = self._slot(pairs), np.arange(len(pairs))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.pair[slot[todo]] < 0
            at, first = np.unique(slot[todo[free]], return_index=True)
            who = todo[free][first]
            self.pair[at], self.rank[at], self.made[at] = pairs[who], who, made[who]
            todo = np.setdiff1d(todo, who)
            slot[todo] += 1

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(U) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _find(self, pairs: np.ndarray) -> np.ndarray:
        """Slots of pairs; a slot with the last rank for those that never merge."""
        slot = self._slot(pairs)
        todo = np.flatnonzero(self.pair[slot] != pairs)
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            todo = todo[self.pair[slot[todo]] >= 0]
            slot[todo] += 1
            todo = todo[self.pair[slot[todo]] != pairs[todo]]
        slot[todo] = len(self.pair) - 1
        return slot

    def _merge(self, ids: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy merges of each stream's ids to the end: in every round, each stream applies its
        earliest merge, at all the places where it holds, from the left."""
        done_ids, done_stream, none = [], [], len(self.rank)
        while len(ids) > 1:
            same = stream[1:] == stream[:-1]
            slot = self._find(np.where(same, ids[:-1] * self.size + ids[1:], -2))
            rank = np.where(same, self.rank[slot], none)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.minimum.reduceat(np.append(rank, none), starts)
            last = np.append(starts[1:], len(ids)) - starts
            over = best >= self.rank[-1]
            who = np.repeat(np.arange(len(starts)), last)
            if over.any():  # these streams are finished
                out = over[who]
                done_ids.append(ids[out])
                done_stream.append(stream[out])
                if over.all():
                    ids = stream = np.zeros(0, np.int64)
                    break
                keep = ~out
                inner = keep[:-1]
                rank, slot = rank[inner][: keep.sum() - 1], slot[inner][: keep.sum() - 1]
                ids, stream, who = ids[keep], stream[keep], who[keep]
            hit = rank == best[who[:-1]]
            if hit.any():  # of overlapping places (a a a), the left one, then every second
                at = np.flatnonzero(hit)
                run = np.concatenate([[True], np.diff(at) > 1])
                pos = np.arange(len(at))
                at = at[(pos - np.maximum.accumulate(np.where(run, pos, 0))) % 2 == 0]
                ids = ids.copy()
                ids[at] = self.made[slot[at]]
                keep = np.ones(len(ids), bool)
                keep[at + 1] = False
                ids, stream = ids[keep], stream[keep]
        done_ids.append(ids)
        done_stream.append(stream)
        ids, stream = np.concatenate(done_ids), np.concatenate(done_stream)
        order = np.argsort(stream, kind="stable")
        return ids[order], stream[order]

    def encode_streams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each pre-token, all in a row, and n + 1 offsets. Memory: one window per stream
        beside the emitted ids."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        end = np.cumsum(sizes)
        at = end - sizes
        widths = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        got_ids, got_stream = [], []
        live = np.flatnonzero(sizes)
        while len(live):
            n = np.minimum(end[live] - at[live], self.window)
            stream = np.repeat(np.arange(len(live)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[live], n)
            ids, stream = self._merge(self.byte_id[data[place]], stream)
            stop = np.cumsum(widths[ids]) - np.repeat(np.cumsum(n) - n, np.bincount(stream, minlength=len(live)))
            whole = at[live] + n == end[live]
            stable = whole[stream] | (stop <= (n - self.lookahead)[stream])
            got_ids.append(ids[stable])
            got_stream.append(live[stream[stable]])
            at[live] += np.bincount(stream[stable], widths[ids[stable]], len(live)).astype(np.int64)
            live = live[~whole]
        if not got_ids:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ids, stream = np.concatenate(got_ids), np.concatenate(got_stream)
        order = np.argsort(stream, kind="stable")
        return ids[order].astype(np.uint32), np.concatenate([[0], np.cumsum(np.bincount(stream, minlength=len(texts)))])

    def _learn(self, tokens: list[str]) -> None:
        new = [w for w in dict.fromkeys(tokens) if w not in self.number]
        if len(self.number) + len(new) > MEMO:
            self.clear()
            new = list(dict.fromkeys(tokens))
        if not new:
            return
        ids, first = self.encode_streams([w.encode() for w in new])
        self.number |= zip(new, range(len(self.number), len(self.number) + len(new)), strict=True)
        end = self.first[-1]
        if end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:end], np.zeros(end + len(ids), np.uint32)])
        self.ids[end : end + len(ids)] = ids
        self.first = np.concatenate([self.first, end + first[1:]])

    def pre_tokens(self, text: str) -> Iterator[list[str | int]]:
        """A text's pre-tokens in lists of about BLOCK characters; special tokens' strings as ids."""
        if self.split_special and any(s in text for s in self.special):
            at = 0
            for found in self.split_special.finditer(text):
                yield from _blocks(text[at : found.start()])
                yield [self.special[found[0]]]
                at = found.end()
            yield from _blocks(text[at:])
        else:
            yield from _blocks(text)

    def portions(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The ids of all texts, about TOKENS pre-tokens at a time: the first text's number, ids, and n + 1
        offsets of that text and those after it. A text may go on in the next portion."""
        tokens: list[str | int] = []
        count, first = [0], 0
        for row, text in enumerate(texts):
            for block in self.pre_tokens(text):
                tokens += block
                if len(tokens) >= TOKENS:
                    yield first, *self._encode(tokens, [*count, len(tokens)])
                    tokens, count, first = [], [0], row
            count.append(len(tokens))
        if len(count) > 1:
            yield first, *self._encode(tokens, count)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and n + 1 offsets."""
        size, parts = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)]
        for first, ids, offsets in self.portions(texts):
            size[first : first + len(offsets) - 1] += np.diff(offsets)
            parts.append(ids)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])

    def _encode(self, tokens: list[str | int], count: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens in a row, and offsets for the numbers of pre-tokens in `count`."""
        special = {k: w for k, w in enumerate(tokens) if isinstance(w, int)} if self.special else {}
        for k in special:
            tokens[k] = ""
        long = [k for k, w in enumerate(tokens) if len(w) > SHORT]
        far = [tokens[k] for k in long]
        for k in long:
            tokens[k] = ""
        self._learn(["", *tokens])
        number = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        sizes = np.diff(self.first)[number]
        base, source = self.first[number], self.ids
        if far or special:  # beyond the table: placed behind it
            ids, first = self.encode_streams([w.encode() for w in far])
            known = self.first[-1]
            source = np.concatenate([self.ids[:known], ids, np.fromiter(special.values(), np.uint32, len(special))])
            base[long], sizes[long] = known + first[:-1], np.diff(first)
            where = list(special)
            base[where], sizes[where] = known + len(ids) + np.arange(len(where)), 1
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        at = np.arange(total[-1]) + np.repeat(base - total[:-1], sizes)
        return source[at], total[np.array(count)]

    def decode(self, ids: list[int], step: int = 4096) -> str:
        """The text of the ids, `step` of them at a time."""
        reader = Reader(self)
        return "".join([reader.read(ids[k : k + step]) for k in range(0, len(ids), step)]) + reader.end()


class Reader:
    """Incremental decoder of one row of ids: bytes through a UTF-8 machine; what isn't UTF-8 becomes
    U+FFFD."""

    def __init__(self, machine: Transducer):
        self.bytes_of = machine.bytes_of.__getitem__
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def read(self, ids: list[int]) -> str:
        return self.utf8.decode(b"".join(map(self.bytes_of, ids)))

    def end(self) -> str:
        return self.utf8.decode(b"", True)


class Answer:
    """What is known of one text's ids so far: their number, both digests, and the ids and the decoded
    text themselves where asked for."""

    def __init__(self, machine: Transducer, whole: bool):
        self.reader, self.n = Reader(machine), 0
        self.ids_digest, self.text_digest = hashlib.sha256(), hashlib.sha256()
        self.ids: list[np.ndarray] | None = [] if whole else None
        self.text: list[str] = []

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.ids_digest.update(ids.astype("<u4").tobytes())
        self._say(self.reader.read(ids.tolist()))
        if self.ids is not None:
            self.ids.append(ids)

    def end(self) -> None:
        self._say(self.reader.end())

    def _say(self, text: str) -> None:
        self.text_digest.update(text.encode())
        if self.ids is not None:
            self.text.append(text)


def _blocks(text: str) -> Iterator[list[str | int]]:
    """The pattern's matches, block by block, as on the whole text. Matches near a block's end may change
    with what follows, so they are left to the next block; a match longer than a block gets a larger one."""
    at, size = 0, BLOCK
    while at < len(text):
        end = at + size
        tokens = PATTERN.findall(text, at, end)
        stop = min(end, len(text))
        while end < len(text) and tokens and stop > end - AHEAD:
            stop -= len(tokens.pop())
        if tokens:
            yield tokens
            at, size = stop, BLOCK
        else:
            size *= 2


_MACHINES: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with `with_ids` also
    ids and decoded.

    Null counts as empty: no ids, an empty text. Special tokens' strings in a text become the
    special ids, as the library does by default. Nothing is shuffled. Texts are read in blocks, and digests
    and the decoder go along with them: a worker holds a batch of at most 1 MB of text (or one text),
    the ids of TOKENS pre-tokens and a table of bounded size; with `with_ids` the batch's results as
    well. Repeated rows give equal rows; an empty table gives none; other columns are ignored.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in pieces(batches, 1 << 20):
            answers: list[Answer] = []
            for first, ids, offsets in machine.portions([t or "" for t in batch.column("text").to_pylist()]):
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    if first + k == len(answers):
                        answers.append(Answer(machine, with_ids))
                    answers[first + k].add(ids[a:b])
            for x in answers:
                x.end()
            out = {
                "doc_id": batch.column("doc_id"), "n_tokens": [x.n for x in answers],
                "ids_sha256": [x.ids_digest.hexdigest() for x in answers], "decoded_sha256": [x.text_digest.hexdigest() for x in answers],
            }
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([x.n for x in answers])])
                ids = np.concatenate([part for x in answers for part in x.ids])
                out |= {"ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))), "decoded": ["".join(x.text) for x in answers]}
            yield pa.RecordBatch.from_pydict(out)

    return bare(docs, "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
