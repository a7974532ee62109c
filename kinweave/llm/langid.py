"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams,
trained by follow-the-regularised-leader with elastic-net penalties, calibrated by temperature."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import U, bare, pieces, read_documents, release_driver, remainder

LETTER = regex.compile(r"\p{L}")
#: n-grams of one to three characters, hashed into so many features.
ORDERS, FEATURES = (1, 2, 3), 1 << 15
#: The bound on the labelled rows that the weights are fitted on: about so many of each language.
ROWS_PER_LANGUAGE = 400
#: A constant factor on TF-IDF values, so that a text's vector has a length of about one.
SCALE = 20.0
#: The share of the fitted rows that is kept back for the temperature.
CALIBRATION = 0.2
#: The class of texts in no language, learned from texts whose characters are shuffled, one for every
#: fourth fitted row. A text goes if it has so many letters and that probability of being such a text.
NOISE, NOISE_SHARE, NOISE_LETTERS, NOISE_SCORE = "noise", 4, 40, 0.9
#: Bytes of text handled at a time.
PIECE = 1 << 19


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all n-grams of the lower-cased texts, and n + 1 offsets by text."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    row = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    found, rows = [], []
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, U)
        for k in range(n):
            h = (h + code[k : k + m]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        ok = row[:m] == row[n - 1 :]
        found.append(((h * U(0xBF58476D1CE4E5B9)) >> U(64 - 15)).astype(np.int32)[ok])
        rows.append(row[:m][ok])
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(low) + 1, np.int64)
    all_rows = np.concatenate(rows)
    order = np.argsort(all_rows, kind="stable")
    return np.concatenate(found)[order], np.concatenate([[0], np.cumsum(np.bincount(all_rows, minlength=len(low)))])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all rows; and the number of rows. A task sums its
    texts first, so it sends at most one row per feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in pieces(batches, PIECE):
            ids, offsets = ngrams(batch.column("text").to_pylist())
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                seen = np.zeros(FEATURES, bool)
                seen[ids[a:b]] = True
                df += seen
            n += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"feature": np.append(at, -1), "df": np.append(df[at], n)})

    out, n = np.zeros(FEATURES, np.int64), 0
    for r in bare(docs, "text").mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        if r.feature < 0:
            n = r.df
        else:
            out[r.feature] = r.df
    return out, n


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages, IDF and scale included
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        ids, offsets = ngrams(texts)
        n = np.diff(offsets)
        logits = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(n)
        if len(full):
            logits[full] = np.add.reduceat(self.weights[ids], offsets[full], axis=0) / n[full, None]
        p = softmax((logits + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        known = np.array([bool(t and LETTER.search(t)) for t in texts], bool)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)], np.where(known, p.max(axis=1), 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal for k classes over rows of (features, values, class); the last
    feature is the bias."""
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(at) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = np.outer(x, p)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def shuffled(text: str) -> str:
    """The text with its characters in another order, the same for equal texts."""
    order = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass"))).permutation(len(text))
    return "".join(np.array(list(text), object)[order]) if text else ""


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, noise: bool = False) -> Model:
    """A model from text and lang of `labelled`. Document frequencies come from all its rows; weights
    and temperature from about `rows_per_language` rows of each language, those whose doc_id has the
    smallest hashes. Rows without lang are left out; without any, the model knows no language. Repeated
    rows count each; very long texts are read whole. With `noise` the model knows the class NOISE too."""
    labelled = bare(labelled, "text", "lang").filter("lang is not null")
    count = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(count)
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    df, n = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1
    share = labelled.sparkSession.createDataFrame([(x, min(1.0, rows_per_language / count[x])) for x in languages], "lang string, share double")
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.join(F.broadcast(share), "lang").filter(uniform < F.col("share")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            if noise:
                some = [x for x in texts if zlib.crc32((x or "").encode("utf-8", "surrogatepass")) % NOISE_SHARE == 0]
                texts, langs = texts + [shuffled(x or "") for x in some], langs + [NOISE] * len(some)
            ids, offsets = ngrams(texts)
            at, size = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                u, c = np.unique(ids[a:b], return_counts=True)
                at.append(u)
                size.append(c.astype(np.int32))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "at": pa.array(at, pa.list_(pa.int32())), "size": pa.array(size, pa.list_(pa.int32()))})

    got = chosen.mapInArrow(run, "lang string, at array<int>, size array<int>").toArrow()
    languages += [NOISE] * (noise and NOISE not in languages)
    number = {x: k for k, x in enumerate(languages)}
    rows = []
    for lang, at, size in zip(got["lang"].to_pylist(), got["at"], got["size"], strict=True):
        at, size = at.values.to_numpy(), size.values.to_numpy()
        if len(at):
            rows.append((at, SCALE * idf[at] * size / size.sum(), number[lang]))
    rows.sort(key=lambda r: (r[2], len(r[0]), r[1].sum()))
    order = np.random.default_rng(3).permutation(len(rows))
    cut = int(len(rows) * CALIBRATION)
    held, used = [rows[i] for i in order[:cut]], [rows[i] for i in order[cut:]]
    w, b = ftrl(used, len(languages))
    logits = np.array([x @ w[at] + b for at, x, _ in held or used]) if rows else np.zeros((0, len(languages)))
    y = np.array([y for *_, y in held or used], int)

    def loss(t: float) -> float:
        return -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).sum()

    t = min(np.exp(np.linspace(-3, 3, 61)), key=loss) if len(y) else 1.0
    del rows, held, used, got
    release_driver(labelled.sparkSession)  # it lives on
    return Model(languages, (w * (SCALE * idf)[:, None]).astype(np.float32), b, float(t))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (calibrated probability).

    A text that is null or has no letter gives `und` and score 0. Only the text is read, whole however
    long. The model (a fixed number of features times languages) is the same on all executors; nothing is
    shuffled. Repeated rows, and rows without doc_id, give equal rows; the first of equally likely
    languages, by name, is given; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            lang, score = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": score})

    return bare(docs, "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def training_part(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return docs.filter(remainder(3) != 1)


def known_language(docs: DataFrame) -> DataFrame:
    """docs without texts in no language: those that are null or have no letter, and those of
    NOISE_LETTERS letters or more that the model takes for shuffled characters with a probability of
    NOISE_SCORE or more. Shorter texts say too little. Rows are filtered where they are read and all
    columns pass through; without any labelled row every text with a letter stays."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_part(docs), noise=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            texts = batch.column("text").to_pylist()
            keep = [bool(t and LETTER.search(t)) for t in texts]
            if shared.value.languages:
                lang, score = shared.value.predict(texts)
                sure = [k for k, (x, s) in enumerate(zip(lang, score, strict=True)) if x == NOISE and s >= NOISE_SCORE]
                for k in sure:
                    keep[k] = keep[k] and sum(1 for _ in LETTER.finditer(texts[k])) < NOISE_LETTERS
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    out = identify(docs, fit(training_part(docs)))
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")
