"""The pipeline as a whole against brute force on a small table, and its stages on odd inputs."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_dedup import brute_classes
from tokenizers import Tokenizer

import corpus_pipeline
from kinweave.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kept int"


@pytest.fixture(scope="module")
def booster(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))


def test_whole_pipeline(spark, awkward, booster, monkeypatch, tmp_path):
    monkeypatch.setattr(pii, "fit", lambda docs: booster)
    planted = [(100 + k, f"{text} {mail} says {k}") for k, (text, mail) in enumerate([("a short note", "a.b@mail.example.org"), ("another one", "x@y.co.uk")])]
    long = [(200, " ".join(random.Random(5).choice(["alpha", "beta", "gamma"]) for _ in range(9000)))]
    digits = [(300, "12 34 %")]
    texts = [*awkward, *planted, *long, *digits]
    # without labels the model knows no language: texts without a letter go, nothing else does
    spark.createDataFrame([(i, t, None, "src", 1, "k", 2) for i, t in texts], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [(i, t) for i, t in texts if t and re.search(r"[^\W\d_]", t)]
    same = collections.defaultdict(list)
    for i, t in left:
        same[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    first = {min(g) for g in same.values()}
    left = [(i, t) for i, t in left if i in first]
    classes = brute_classes(left)
    left = [(i, t) for i, t in left if classes[i][1] == i]
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i, t in left:
        ids = [*library.encode(mail.sub("[EMAIL]", t), add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[i, piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 4096
    assert len(places) == -(-sum(n for _, n, _ in want.values()) // 4096)  # the fewest there can be, here


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages_keep_columns_and_rows_without_ids(spark, empty, booster, monkeypatch, name, stage):
    monkeypatch.setattr(pii, "fit", lambda docs: booster)
    assert stage(spark, empty, "").columns == empty.columns and stage(spark, empty, "").collect() == []
    rows = [(None, "one text that has no id", None, None, None, None, None), (1, "plain words of a short text", "en", "s", 1, "k", 0), (1, "plain words of another text", "en", "s", 1, "k", 0)]
    out = stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(rows, key=repr)
