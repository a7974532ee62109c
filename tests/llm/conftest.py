"""Small texts that hold the awkward cases of every operator."""

import random

import pytest

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "a", "Haus", "straße", "é"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): null, empty, blank, one word, very long, repeated texts and passages, ties."""
    rng = random.Random(3)
    passage, long = prose(rng, 60), prose(rng, 9000)
    texts = [None, "", " \n\t ", "word", "a " * 120, long, prose(rng, 80), prose(rng, 30) + " " + passage + " " + prose(rng, 20), passage, passage.replace(" ", "\n "), "x" * 5000, "Grüße 😀 " * 20]
    base = prose(rng, 100).split()
    for k in range(12):  # near copies of one text
        copy = list(base)
        copy[rng.randrange(100)] = f"new{k}"
        texts.append(" ".join(copy))
    texts += [texts[6], texts[6] + " "]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """With columns whose names could clash with the operators' own."""
    rows = [(i, t, "en", "src", 1, "k", 2) for i, t in awkward]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, key string, kept int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
