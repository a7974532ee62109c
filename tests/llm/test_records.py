"""Mixing, manifests and conversation repair against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from kinweave.llm import merkle, mixing, repair

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, size int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def some_rows(n, seed=1):
    """Half of all rows in one source, a source of one row, null sources, ids, texts and repeated rows."""
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice(["Ab", "cd", "É", "..", "7"]) for _ in range(rng.randrange(0, 40))), rng.choice(["en", None]), "hot" if k % 2 else rng.choice(["a", "b", "é", "", None]), rng.choice([None, k]), "g", 1) for k in range(n)]
    rows += [(None, None, None, None, None, "g", 1), (None, "x Y", "en", "hot", 3, "g", 1), (3, "other", "en", "hot", 1, "g", 1), (5, "Lone", "en", "lone", 1, "g", 1), (9, "w " * 30000, "en", "long", 1, "g", 1)]
    return rows + rows[:2]


# ---- manifests ---------------------------------------------------------------------------------


def plain_manifest(rows, fan):
    def leaf(r, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        """root, and for each node its siblings by level as (left, right)"""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                run = k // fan * fan
                paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + fan])))
            nodes, at = [sha("".join(nodes[k : k + fan])) for k in range(0, len(nodes), fan)], [k // fan for k in at]
        return nodes[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        built[s] = (mine, *tree([leaf(r, r[1]) for r in mine]))
    root, tops = tree([built[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        mine, subroot, paths = built[s]
        for r, path in zip(mine, paths, strict=True):
            text, whole = r[1], path + top
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = leaf(r, text)
            for left, right in whole:
                node = sha(left + node + right)
            out.append((r[0], leaf(r, r[1]), subroot, root, sha("".join(a + b for a, b in whole)), node, node == root))
    return out


def check_manifest(spark, rows, parts, fan, height):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    m = merkle.manifest(df, merkle.tampered_text(), fan, height)
    m = m.withColumn("folded", merkle.folded(merkle.F.coalesce("tampered", "leaf"), m.proof)).withColumn("digest", merkle.proof_digest(m.proof))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.digest, r.folded, r.folded == r.root) for r in m.collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows, fan), key=repr)


def test_manifest(spark):
    """Trees of many levels and ragged ends: a small fan and low blocks, so ranges and blocks meet anywhere."""
    check_manifest(spark, some_rows(150), 5, 3, 2)
    check_manifest(spark, some_rows(600, 3), 4, 16, 1)
    check_manifest(spark, [(7, "A", "en", "s", 1, "g", 1)], 1, 16, 3)


def test_audit_columns_and_empty_tables(spark):
    rows = some_rows(40)
    df = spark.createDataFrame(rows, SCHEMA)
    got = merkle.audited(df, merkle.tampered_text())
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_manifest(rows, 16), key=repr)
    assert not all(r.verified for r in got.collect())
    assert merkle.audited(df.limit(0), merkle.tampered_text()).collect() == []


# ---- mixing ------------------------------------------------------------------------------------


def plain_targets(sizes, weights, most):
    """By rounds: what is above its limit stops there, the excess is reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left, free = total - sum(most * sizes[s] for s in stopped), [s for s in order if s not in stopped]
        level = left / sum(w[s] for s in free) if free else 0
        above = {s for s in free if w[s] * level > most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s]) if s in stopped else w[s] * level for s in order}
        stopped |= above


def plain_mix(rows, seed=mixing.SEED):
    sized = [(r[0], r[3], len(WORD.findall(r[1] or "")), (r[1] or "").encode()) for r in rows]
    sizes = defaultdict(int)
    for r in sized:
        sizes[r[1]] += r[2]
    goal = plain_targets(sizes, mixing.WEIGHTS, mixing.MOST)

    def key(r):
        u = (int(hashlib.md5(f"{seed}#{r[0]}".encode() if r[0] is not None else f"{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, letters = len(re.sub(rb"[\x20\x09-\x0D]", b"", r[3])), len(re.sub(rb"[^A-Za-z\x80-\xff]", b"", r[3]))
        return -math.log(u) / ((n + 9 * letters) / (10 * n) if n else 0.1), r[0] is not None, r[0] or 0, r[2]

    out = []
    for s, size in sizes.items():
        words = math.floor(goal[s] + 0.5)
        epochs, rest = divmod(words, size) if size else (0, 0)
        for r in sorted((r for r in sized if r[1] == s), key=key):
            part = max(0, min(r[2], rest))
            rest -= part
            out.append((r[0], r[2], size, round(goal[s], 6), epochs * r[2] + part))
    return out


def test_mix(spark):
    for rows in (some_rows(200), some_rows(60, 4)):
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect()]
        assert sorted(got, key=repr) == sorted(plain_mix(rows), key=repr)
        assert all(t <= 3 * size for _, size, _, _, t in got)


def test_targets_stop_at_their_limit_and_reshare(spark):
    rng = random.Random(5)
    for n in (1, 2, 7, 40):
        sizes = {f"s{k:02}": rng.choice([0, 1, 3, 50, 1000, 100000]) for k in range(n)} | {None: 10}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = plain_targets(sizes, mixing.WEIGHTS, mixing.MOST)
        assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in want.items()}
        assert math.isclose(sum(r.target for r in got), sum(sizes.values()))


@pytest.mark.parametrize("size", [430_000_000, 1_600_000_000, 2_147_483_000, 3_000_000_000_000])
def test_targets_of_sizes_near_the_end_of_an_int(spark, size):
    """A weight times the words of all sources is more than an int holds, also where the words alone are not."""
    sizes = {"a": size // 2, "b": size // 4, "c": size // 4, None: 10}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes, mixing.WEIGHTS, mixing.MOST)
    assert {r.source: r.target for r in got} == pytest.approx(want)


def test_mix_of_nothing(spark, empty):
    assert mixing.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None, "g", 1), (2, " ", None, "a", None, "g", 1)], SCHEMA)
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# ---- conversation repair -----------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, g string, pos int"
INK = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, kinds):
    """(cost, audit, repaired lines) by recursion over rows and the roles so far."""
    n = len(rows)

    @cache
    def best(i, state, inserted):
        """state: the last initial, or empty"""
        found = [(0, "", None)] if i == n and state in ("", "a") else []
        take = lambda cost, letter, key: (cost + best(*key)[0], letter + best(*key)[1], (letter, key))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        free = follows[-1]
        if inserted < 3:
            found.append(take(3, "I", (i, free, inserted + 1)))
        if i < n:
            found.append(take(4, "D", (i + 1, state, 0)))
            if kinds[i] in (None, "truncated"):
                more = 3 if kinds[i] else 0
                found.append(take(3 + more, "R", (i + 1, free, 0)))
                if rows[i][2][:1] and rows[i][2][:1] in follows:
                    found.append(take(more, "K", (i + 1, rows[i][2][:1], 0)))
        return min(found, key=lambda x: x[:2], default=(10**9, "", None))

    cost, audit, step = best(0, "", 0)
    key, lines = (0, "", 0), []
    while best(*key)[2]:
        letter, after = best(*key)[2]
        role = {"u": "user", "a": "assistant"}.get(after[1])
        lines += [f"{role}:"] if letter == "I" else [f"{role}:{rows[key[0]][3]}"] if letter == "R" else [f"{rows[key[0]][2]}:{rows[key[0]][3]}"] if letter == "K" else []
        key = after
    return cost, audit, lines


def plain_repair(rows, ids):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = []
    for conv in ids:
        mine = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3])))
        kinds, seen = [], set()
        for r in mine:
            ink = INK.findall(r[3])
            kinds.append("blank" if not ink else "duplicate" if r[2:] in seen else "truncated" if ink[-1] not in ".!?" else None)
            seen.add(r[2:])
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(mine, kinds)
        out.append((conv, gaps, *[kinds.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines))))
    return out


def some_turns(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ümlaut", "sys:tem"])
            rows.append((c, rng.choice([t, t, t, t + 2, None]), role, rng.choice(["Yes.", "Why? ", "no end", " \t", None, "", "Ä!\n\n", "x" * 500 + "."]) if t % 3 else f"Text {t}.", "g", 1))
    return rows


@pytest.mark.parametrize(("seed", "convs", "most", "segment", "fold"), [(1, 60, 9, 1024, 1024), (2, 25, 30, 4, 2), (3, 12, 40, 3, 3)])
def test_repair(spark, seed, convs, most, segment, fold):
    rows = some_turns(seed, convs, most)
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    damaged = plain_damage(rows)
    assert sorted(map(tuple, repair.damage(df).collect()), key=repr) == sorted(damaged, key=repr)
    got = repair.repair(repair.damage(df), df, segment, fold).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_repair(damaged, {r[0] for r in rows}), key=repr)


def test_a_long_conversation(spark):
    """One conversation of most rows, with production parameters: several segments."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"Text {t}{rng.choice(['.', ''])}", "g", 1) for t in range(2500)] + [(2, 1, "user", "Hi.", "g", 1)]
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[2][1:8] == (0, 0, 0, 0, 0, 3, "KI")
    words = "".join({"u": "u", "a": "a", "s": "s"}[r[2][0]] if r[3].endswith(".") else r[2][0].upper() for r in rows[:-1])
    cost, _, edits = repair.trace(words, repair.END, repair.START, True)
    assert (got[1].cost, got[1].audit) == (cost, "".join("I" * len(a) + b for a, b, _ in edits))


def test_repaired_rows_follow_the_grammar(spark):
    rows = some_turns(4, 30, 12)
    df = spark.createDataFrame(rows, TURNS)
    out = defaultdict(list)
    for r in sorted(repair.repaired_rows(df, 4, 2).collect(), key=lambda r: r.number):
        out[r.conv_id].append((r.role, r.text))
    want = {c: h for c, *_, h in plain_repair([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x, *_ in rows], {r[0] for r in rows})}
    assert {c: sha("\n".join(f"{r}:{t}" for r, t in lines)) for c, lines in out.items()} == {c: h for c, h in want.items() if h != sha("")}
    assert all(re.fullmatch("s?(ua)+", "".join(r[:1] for r, _ in lines)) for lines in out.values())


def test_repair_of_nothing(spark):
    nothing = spark.createDataFrame([], TURNS)
    ids = spark.createDataFrame([(1,), (None,)], "conv_id long")
    assert sorted(map(tuple, repair.repair(nothing, ids).collect()), key=repr) == [(1, 0, 0, 0, 0, 0, 0, "", sha("")), (None, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert repair.repair(nothing).collect() == []
