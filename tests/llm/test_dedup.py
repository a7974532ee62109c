"""Dedup operators against brute force."""

import collections
import hashlib
import random
import re

import pytest

from kinweave.llm.components import components, joined
from kinweave.llm.common import Scratch
from kinweave.llm.exact import exact_dedup, keep_first
from kinweave.llm.jaccard import jaccard_classes, keep_one
from kinweave.llm.lm import language_model
from kinweave.llm.quality import quality
from kinweave.llm.substring import plan_rounds, substring_dedup
from kinweave.llm import suffix
from kinweave.llm.suffix import suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact(docs, awkward, empty):
    groups = collections.defaultdict(list)
    digest = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for i, t in awkward}
    for i, h in digest.items():
        groups[h].append(i)
    out = exact_dedup(docs).collect()
    assert sorted(r.doc_id for r in out) == [i for i, _ in awkward]
    for r in out:
        g = groups[digest[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), r.doc_id == min(g), digest[r.doc_id])
    assert exact_dedup(empty).collect() == []
    kept = keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_keepers_without_or_with_repeated_doc_ids(spark):
    rows = [(1, "a b c d e f"), (1, "other text of its own here"), (None, "a b c d e f"), (None, "only here without an id"), (2, "A b c d e f"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, keep_first(df).collect()), key=repr) == sorted([rows[0], rows[1], rows[3], rows[4], rows[6]], key=repr)
    assert sorted(map(tuple, keep_one(df).collect()), key=repr) == sorted([rows[0], rows[1], rows[3], rows[5], rows[6]], key=repr)


def thue_morse():
    x, y = "a", "b"
    for _ in range(10):
        x, y = x + y, y + x
    return x, y


def met_in_the_middle(seed):
    """Two words of 16 letters and digits that collide under an invertible step on eight bytes at a time: the
    second half makes up for the first."""
    rng, one, two, three = random.Random(seed), 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1

    def step(v):
        v = (v ^ v >> 30) * one & three
        v = (v ^ v >> 27) * two & three
        return v ^ v >> 31

    fine = set(b"!#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[]^_`abcdefghijklmnopqrstuvwxyz{|}~")
    begin = step((16 * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) & three)
    halves = [bytes(rng.choice(sorted(fine)) for _ in range(8)) for _ in range(2)]
    state = step(begin ^ int.from_bytes(halves[0], "little"))
    while True:
        other = bytes(rng.choice(sorted(fine)) for _ in range(8))
        rest = (step(begin ^ int.from_bytes(other, "little")) ^ state ^ int.from_bytes(halves[1], "little")).to_bytes(8, "little")
        if other != halves[0] and set(rest) <= fine:
            return b"".join(halves).decode(), (other + rest).decode()


@pytest.mark.parametrize("make", [thue_morse, lambda: met_in_the_middle(1), lambda: met_in_the_middle(2), lambda: ("abcdefghijklmnop", "s7e.2fmc+9'9[gbd")])
def test_structured_words_are_told_apart(spark, make):
    """Words made to collide: under any polynomial modulo 2^64, and under a mixing step that can be undone."""
    x, y = make()
    tail = " ".join(f"w{k}" for k in range(34))
    df = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup(df, with_text=False).collect()] == [0, 0]
    one = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_classes(one).collect()} == {1: 1, 2: 2}
    lines = spark.createDataFrame([(1, f"{x}\n{y}\n{x}")], "doc_id long, text string")
    assert [r.n_dup_lines for r in quality(lines).collect()] == [1]
    scored, _ = language_model(spark.createDataFrame([(1, y)], "doc_id long, text string"), spark.createDataFrame([(1, x)], "doc_id long, text string"))
    assert [r.n_known for r in scored.collect()] == [1]  # the end only


def test_exact_hot_group(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(300)], "doc_id long, text string")
    out = {r.doc_id: r for r in exact_dedup(df, support=8).collect()}
    assert len(out) == 300 and out[299].keep_id == 1 and out[299].group_size == 200 and out[3].kept


def brute_words(texts, window):
    words = {i: WORD.findall(t or "") for i, t in texts}
    count = collections.Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window", [35, 12])
def test_substring(docs, awkward, window):
    want = brute_words(awkward, window)
    out = substring_dedup(docs, window).collect()
    assert sorted(r.doc_id for r in out) == [i for i, _ in awkward]
    for r in out:
        assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id][2].encode()).hexdigest()


def test_substring_random(spark, empty):
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") for _ in range(400)]
    texts = [(i, " ".join(base[(a := rng.randrange(350)) : a + rng.randrange(10, 50)] + [rng.choice("ab") for _ in range(rng.randrange(60))])) for i in range(60)]
    want = brute_words(texts, 35)
    out = substring_dedup(spark.createDataFrame(texts, "doc_id long, text string"), with_text=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in out} == {i: w[:2] for i, w in want.items()}
    assert substring_dedup(empty).collect() == []


def test_rounds_leave_a_whole_phrase():
    for window in range(8, 200):
        rounds, margin = plan_rounds(window)
        assert rounds and window - 2 * margin >= 4 * max(k for _, k in rounds) - 1


def brute_bytes(texts):
    data, first = {i: (t or "").encode() for i, t in texts}, {}
    for i in sorted(data):
        for k in range(len(data[i]) - 49):
            first.setdefault(data[i][k : k + 50], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def test_suffix(docs, awkward, empty):
    want = brute_bytes(awkward)
    out = suffix_dedup(docs).collect()
    assert sorted(r.doc_id for r in out) == [i for i, _ in awkward]
    for r in out:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id][3]).hexdigest() and len(r.spans) == r.n_spans
    assert suffix_dedup(empty).collect() == []


def test_suffix_random(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abé ") for _ in range(800))
    texts = [(i, base[(a := rng.randrange(700)) : a + rng.randrange(20, 140)] + "".join(rng.choice("ab") for _ in range(rng.randrange(80)))) for i in range(60)]
    texts += [(60, "a" * 200), (61, "a" * 90), (62, "ab" * 60)]
    want = brute_bytes(texts)
    out = suffix_dedup(spark.createDataFrame(texts, "doc_id long, text string"), with_text=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in out} == {i: w[:3] for i, w in want.items()}


def test_suffix_hot_passage(spark):
    """A passage in a third of the documents, other text around it: its edge anchors leave the buckets."""
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = some(150), some(90)
    texts = [(i, some(90) + (passage if i % 3 == 0 else other if i % 5 == 0 else "") + some(rng.randrange(90))) for i in range(90)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert len(suffix.hot_anchors(df, 16, 1)) >= 2 and not len(suffix.hot_anchors(df, 1000, 1))
    want = brute_bytes(texts)
    for hot, sample in ((1, 1), (16, 1), (16, 4)):
        out = suffix_dedup(df, hot=hot, sample=sample).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == want


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w)} if len(w) < 5 else set(zip(*[w[k:] for k in range(5)], strict=False))


def brute_classes(texts):
    sets, up = {i: shingle_set(t) for i, t in texts}, {i: i for i, _ in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard(docs, awkward, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs).collect()}
    assert got == brute_classes(awkward)
    assert jaccard_classes(empty).collect() == []
    assert keep_one(docs).columns == docs.columns


def test_jaccard_large_groups(spark):
    """A group of near copies that are linked only in chains, and a passage that most texts share."""
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(4000)}"
    passage, texts, chain = [word() for _ in range(40)], [], [word() for _ in range(120)]
    for _ in range(70):
        chain = list(chain)
        for _ in range(rng.choice([1, 2, 3, 9])):
            chain[rng.randrange(120)] = word()
        texts.append(" ".join(chain))
    texts += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]) for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(k % 12)]) for k in range(40)]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_classes(texts)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(links, Scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_joined_components_equal_those_of_all_links(spark):
    """Links that come in parts, some without any new node, give what all of them give at once."""
    rng, scratch, label, every = random.Random(4), Scratch(spark, "test"), None, []
    for n in (25, 6, 12):
        part = [tuple(rng.sample(range(60), 2)) for _ in range(n)]
        every += part
        label = joined(label, spark.createDataFrame(part, "a long, b long"), scratch)
        whole = components(spark.createDataFrame(every, "a long, b long"), scratch)
        got = sorted(map(tuple, label.collect()))
        assert got == sorted(map(tuple, whole.collect())) and len(got) == len({x for link in every for x in link})


def test_rounds_without_links_join_nothing(spark):
    """The driver keeps something of each job: a round that finds no link starts none for components."""
    rng = random.Random(1)
    passage, word = " ".join(f"p{k}" for k in range(12)), lambda: f"w{rng.randrange(50)}"
    texts = [(k, f"{passage} " + " ".join(word() for _ in range(30))) for k in range(30)]
    spark.sparkContext.setJobGroup("unlinked", "texts with a common passage")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("unlinked"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == brute_classes(texts) and {c for _, c in got.values()} == set(range(30))
    assert 0 < jobs < 80  # 110 with components after each round
