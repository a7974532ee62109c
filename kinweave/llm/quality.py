"""Quality rules as a short-circuit cascade: cheap rules that reject much run first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import U, bare, chain, mix, pieces, repeated, row_of, row_sums, span_hashes, spans_of, text_bytes, word_spans

#: The symbol characters of the contract.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Documents on which costs and rejections are estimated; only the order of the rules depends on it.
SAMPLE, SAMPLE_CHARS = 400, 20_000


#: Measures of a text each, which a subset of the texts takes over.
_BY_TEXT = {"n_words", "word_chars", "n_symbols", "letter_words", "lines", "repeat"}


class Texts:
    """A batch of texts with measures that are computed once, on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._kept = data, offsets, {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def subset(self, rows: np.ndarray) -> Texts:
        """Some of the texts, with what was measured of them."""
        keep = np.zeros(len(self), bool)
        keep[rows] = True
        sizes = np.diff(self.offsets)
        out = Texts(self.data[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]))
        out._kept = {name: value[keep] for name, value in self._kept.items() if name in _BY_TEXT}
        return out

    def _once(self, name: str, make: Callable):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def words(self):
        return self._once("words", lambda: word_spans(self.data, self.offsets))

    def hashes(self) -> np.ndarray:
        return self._once("hashes", lambda: span_hashes(self.data, *self.words()[:2]))

    def n_words(self) -> np.ndarray:
        return self._once("n_words", lambda: np.diff(self.words()[2]))

    def word_chars(self) -> np.ndarray:
        return self._once("word_chars", lambda: row_sums(((self.data & 0xC0) != 0x80) & ~((self.data == 32) | ((self.data >= 9) & (self.data <= 13))), self.offsets))

    def n_symbols(self) -> np.ndarray:
        return self._once("n_symbols", lambda: row_sums(SYMBOLS[self.data], self.offsets))

    def letter_words(self) -> np.ndarray:
        def make():
            starts, ends, first = self.words()
            letters = np.zeros(len(self.data) + 1, np.int64)
            np.cumsum(LETTER[self.data], out=letters[1:])
            return row_sums(letters[ends] > letters[starts], first)

        return self._once("letter_words", make)

    def lines(self) -> np.ndarray:
        """By text, in two columns: lines with a word, and those of them equal to an earlier line."""

        def make():
            starts, ends, first = spans_of(self.data != 10, self.offsets)
            w = self.words()[0]
            full = np.searchsorted(w, ends) > np.searchsorted(w, starts)
            row = row_of(first)
            key = mix(span_hashes(self.data, starts, ends)[full] + row[full].astype(U) * U(0x9E3779B97F4A7C15))
            at = np.unique(key, return_index=True)[1]
            n = np.bincount(row[full], minlength=len(self))
            return np.stack([n, n - np.bincount(row[full][at], minlength=len(self))], axis=1)

        return self._once("lines", make)

    def n_repeat_words(self) -> np.ndarray:
        def make():
            h, first = self.hashes(), self.words()[2]
            tri, row = chain(h, 3), row_of(first)
            inside = row[: len(tri)] == row[2:]
            key = mix(tri[inside] + row[: len(tri)][inside].astype(U) * U(0x9E3779B97F4A7C15))
            at = np.flatnonzero(inside)[repeated(key)]
            covered = np.zeros(len(h), bool)
            for k in range(3):
                covered[at + k] = True
            return row_sums(covered, first)

        return self._once("repeat", make)


@dataclass(frozen=True)
class Rule:
    """rejects(texts) -> one boolean per text."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def base_failed(t: Texts) -> np.ndarray:
    return (t.n_words() < 50) | (100 * t.n_repeat_words() > 50 * t.n_words())


#: The base rules of the contract, then the method's own; each reads whole texts.
RULES = (
    Rule("too_few_words", lambda t: t.n_words() < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words() > 50 * t.n_words()),
    Rule("symbols", lambda t: 4 * t.n_symbols() > t.n_words()),
    Rule("word_length", lambda t: (t.word_chars() < 2 * t.n_words()) | (t.word_chars() > 20 * t.n_words())),
    Rule("no_letters", lambda t: 2 * t.letter_words() < t.n_words()),
    Rule("repeated_lines", lambda t: (t.lines()[:, 0] >= 4) & (2 * t.lines()[:, 1] > t.lines()[:, 0])),
)


def cascade(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """Index of the first rule that rejects each text, -1 if none: later rules never see it."""
    out, left, rows = np.full(len(texts), -1), texts, np.arange(len(texts))
    for k, rule in enumerate(rules):
        if not len(rows):
            break
        bad = rule.rejects(left)
        if bad.any():
            out[rows[bad]] = k
            rows, left = rows[~bad], left.subset(np.flatnonzero(~bad))
    return out


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> tuple[Rule, ...]:
    """rules ordered by rejection per cost, both estimated on at most `sample` documents (those
    with the smallest hashes), of which the first SAMPLE_CHARS characters each are looked at. The verdict
    doesn't depend on the order, only the work does."""
    short = bare(docs, "text").filter("text is not null")
    ids = [r.doc_id for r in short.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(sample).collect()]
    texts = [r.text for r in short.filter(F.col("doc_id").isin(ids)).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(sample).collect()] if ids else []
    if not texts:
        return rules
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    rank = {}
    for rule in rules:
        fresh = Texts(data, offsets)  # each rule pays for all that it measures
        began = time.perf_counter()
        rejected = rule.rejects(fresh).mean()
        rank[rule.name] = (rejected + 0.5 / len(texts)) / max(time.perf_counter() - began, 1e-9)
    return tuple(sorted(rules, key=lambda r: -rank[r.name]))


METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, metrics: bool = True) -> DataFrame:
    """One row per document: doc_id, kept, reason (the rule that rejected it first in the cascade's
    order, else null), and with `metrics` the measures of METRICS.

    Words are [^\\x20\\x09-\\x0D]+; null counts as a text without words, and is rejected like any
    text of under 50 words. The cascade runs on Arrow batches; a text that one rule rejects is not
    seen by the next, and measures that are asked for of all texts are taken once. Very long texts are
    batches of their own. The order of rules that reject equally much for their cost is that of `rules`. Repeated
    rows give a row each; an empty table gives none. Other columns are ignored, whatever their names.
    """
    order = plan(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            t = Texts(*text_bytes(batch.column("text")))
            measures = {}
            if metrics:  # asked for of all texts, so the cascade looks them up
                measures = {"n_words": t.n_words(), "word_chars": t.word_chars(), "n_symbols": t.n_symbols(), "n_dup_lines": t.lines()[:, 1], "n_repeat_words": t.n_repeat_words(), "base_failed": base_failed(t)}
            first = cascade(t, order)
            out = {"doc_id": batch.column("doc_id"), "kept": first < 0, "reason": pa.array([order[k].name if k >= 0 else None for k in first], pa.string())}
            yield pa.RecordBatch.from_pydict(out | measures)

    return bare(docs, "text").mapInArrow(run, "doc_id long, kept boolean, reason string" + (", " + METRICS) * metrics)
