"""Models fitted over junction trees, chosen marginals, redrawn columns, sizes, pairs, classes and factors."""

import math
import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from kinweave.operators import factors, groups, junction, latent, marginals, permute, sampling
from kinweave.operators.ordered import number_within

DOMAIN = {"a": ["x", "y", "z"], "b": [0, 1], "c": [0, 1, 2], "e": ["p", "q"]}
SETS = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "e")]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    out = []
    for _ in range(800):
        a, b = rng.choice("xyz"), rng.randrange(2)
        c = (ord(a) + b) % 3 if rng.random() < 0.7 else rng.randrange(3)
        out.append((a, b, c, "p" if rng.random() < 0.2 + 0.3 * c else "q"))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "a string, b int, c int, e string")


def count(rows, attrs):
    return Counter(tuple(r["abce".index(x)] for x in attrs) for r in rows)


def fit_joint(targets, total, rounds):
    joint = {k: total / 36 for k in product(*DOMAIN.values())}
    for _ in range(rounds):
        for s, t in targets:
            at = ["abce".index(x) for x in s]
            sums = Counter()
            for k, v in joint.items():
                sums[tuple(k[i] for i in at)] += v
            joint = {k: v * t.get(tuple(k[i] for i in at), 0) / sums[tuple(k[i] for i in at)] if sums[tuple(k[i] for i in at)] else 0 for k, v in joint.items()}
    return joint


def project(joint, s):
    out = Counter()
    for k, v in joint.items():
        out[tuple(k["abce".index(x)] for x in s)] += v
    return out


def test_fit_equals_the_joint_fit(spark, df, rows):
    tree = junction.JunctionTree(df, DOMAIN, SETS, float(len(rows)))
    assert [set(c) for c in tree.cliques] == [{"a", "b", "c"}, {"c", "e"}]
    tree.fit({s: marginals.marginal(df, list(s)) for s in SETS}, 6)
    joint = fit_joint([(s, count(rows, s)) for s in SETS], len(rows), 6)
    for s in [("a", "b", "c"), ("c", "e"), ("b",), ("c",)]:
        got = {tuple(r[x] for x in s): r.v for r in tree.marginal(s).collect()}
        assert all(abs(got[k] - v) < 1e-6 for k, v in project(joint, s).items())
    with pytest.raises(ValueError):
        tree.home(("a", "e"))
    with pytest.raises(ValueError):
        junction.JunctionTree(df, DOMAIN, SETS, 1.0, limit=10)


def test_marginals_are_chosen_by_their_error(spark, df, rows):
    """Without noise: each round's errors and choice follow from the fit of the joint table."""
    tree = junction.JunctionTree(df, DOMAIN, [("a", "b", "c"), ("c", "e")], float(len(rows)))
    measured = {(x,): marginals.marginal(df, [x]) for x in DOMAIN}
    tree.fit(measured, 1)
    found = junction.select_marginals(df, tree, measured, SETS, [1, 2, 1], 0.0, 0.0, 1, fit_rounds=5)
    have, left, want = [(x,) for x in DOMAIN], list(SETS), []
    joint = fit_joint([(s, count(rows, s)) for s in have], len(rows), 1)
    for r, n in enumerate([1, 2, 1]):
        error = {s: sum(abs(count(rows, s)[k] - v) for k, v in project(joint, s).items()) / 2 for s in left}
        order = sorted(error, key=lambda s: (-error[s], s))
        want += [(r, s, round(error[s], 5), k < n) for k, s in enumerate(order)]
        have, left = [*have, *order[:n]], order[n:]
        joint = fit_joint([(s, count(rows, s)) for s in sorted(have, key=lambda s: (tree.home(s), s))], len(rows), 5)
    assert [(c.round, c.marginal, round(c.error, 5), c.chosen) for c in found] == want
    assert set(measured) == set(have)


def test_selection_stops_when_nothing_is_wrong(spark, df, rows):
    tree = junction.JunctionTree(df, DOMAIN, SETS, float(len(rows)))
    measured = {s: marginals.marginal(df, list(s)) for s in SETS}
    tree.fit(measured, 30)
    assert {c.round for c in junction.select_marginals(df, tree, measured, SETS[:2], [1, 1], 0.0, 0.0, 1, enough=0.5)} == {0}


def test_resampled_columns(spark):
    rows = spark.createDataFrame([(k, "s" if k % 2 else None, "new" if k % 7 == 0 else "t", "old") for k in range(4000)], "k int, s string, t string, x string")
    f = spark.createDataFrame([(None, "A", 0.0), (None, "B", math.log(3)), ("s", "A", 1000.0), ("s", "B", 1000.0)], "s string, x string, v double")
    g = spark.createDataFrame([("t", "A", 0.0), ("t", "B", math.log(2)), ("t", "C", 9.0)], "t string, x string, v double")
    got = sampling.resample_column(rows, "x", [f, g, g.drop("x").distinct()], F.col("k"))
    assert got.columns == rows.columns
    counts = Counter((r.s, r.t, r.x) for r in got.collect())
    assert counts["s", "new", "old"] + counts[None, "new", "old"] == sum(k % 7 == 0 for k in range(4000))
    assert abs(counts[None, "t", "B"] / (counts[None, "t", "A"] + counts[None, "t", "B"]) - 6 / 7) < 0.03
    assert abs(counts["s", "t", "B"] / (counts["s", "t", "A"] + counts["s", "t", "B"]) - 2 / 3) < 0.04 and not counts["s", "t", "C"]


@pytest.mark.parametrize(("n", "h"), [(100, {2: 20, 5: 12}), (101, {2: 20, 5: 12}), (7, {3: 1}), (1, {9: 4}), (0, {2: 1}), (500, {1: 3, 4: 2, 0: 9, 7: 1})])
def test_group_ids(spark, n, h):
    rows = spark.createDataFrame([(k,) for k in range(n)], "k int")
    got = groups.group_ids(rows, "k", spark.createDataFrame(list(h.items()), "size int, n int"), 3)
    sizes = Counter(Counter(r.group for r in got.collect()).values())
    assert sum(s * c for s, c in sizes.items()) == n == got.count()
    if n == 100:
        assert sizes == {2: 20, 5: 12}
    if n == 500:  # 1200 in 6 groups on average: shares of sizes within a group of their expectation
        m = sum(sizes.values())
        assert all(abs(sizes[s] - m * c / 6) <= 1.5 for s, c in h.items() if s)


def test_pairs_of_a_large_group(spark):
    """100,000 members: their 5e9 pairs are never made."""
    child = spark.range(100_000).select(F.lit(1).alias("fk"), F.col("id").alias("x")).unionByName(spark.range(4).select(F.lit(2).alias("fk"), (-F.col("id")).alias("x")))
    members = number_within(child, ["fk"], [F.col("x")], "rn").withColumn("rn", (F.col("rn") + 1).cast("int")).join(child.groupBy("fk").agg(F.count(F.lit(1)).alias("n")), "fk")
    got = permute.capped_pairs(members, "fk", ["x"], 50).collect()
    large = [r for r in got if r.fk == 1]
    assert len(large) == 50 and all(0 < r.rn_a < r.rn_b <= 100_000 and r.a_x == r.rn_a - 1 and r.weight == 2000 for r in large)
    assert max(r.rn_b for r in large) > 80_000 and {(r.rn_a, r.rn_b) for r in got if r.fk == 2} == {(a, b) for b in range(2, 5) for a in range(1, b)}


def test_unranked_pairs(spark):
    k = [*range(50), 2**52 + 12345, 4999950000 - 1, 50000 * 99999 // 1 - 7]
    a, b = permute.unranked(F.col("k"))
    for r in spark.createDataFrame([(x,) for x in k], "k long").select("k", a.alias("a"), b.alias("b")).collect():
        assert 0 < r.a < r.b and (r.b - 1) * (r.b - 2) // 2 + r.a - 1 == r.k


def test_multisets_and_maps(spark):
    whole = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "a"), (None, "a")], "k int, x string")
    part = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (2, "a"), (3, "a"), (None, "a")], "k int, x string")
    assert {r.k: r.contained for r in groups.multiset_contains(whole, part, "k", "x").collect()} == {1: True, 2: False, 3: False, None: True}
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "a", 0), (1, None, 9), (2, "a", None)], "k int, n string, v int")
    assert {r.k: r.entries for r in groups.map_per_key(df, "k", "n", "v").collect()} == {1: {"a": 0, "b": 2}, 2: {"a": None}}


def test_classes_are_found(spark):
    """Two classes of rows that agree in two columns: soft assignment tells them apart."""
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        k = rng.random() < 0.5
        flip = lambda good, bad: good if rng.random() < 0.9 else bad
        rows.append((flip("l" if k else "r", "r" if k else "l"), flip(1 if k else 2, 2 if k else 1), flip("u" if k else None, None if k else "u")))
    df = spark.createDataFrame(rows, "x string, y int, z string")
    cells = latent.soft_classes(df, ["x", "y", "z"], 2, 12, 4)
    hard = {(r.x, r.y, r.z): r["class"] for r in latent.hard_classes(cells).collect()}
    assert hard["l", 1, "u"] != hard["r", 2, None] and len({hard["l", 1, "u"], hard["l", 1, None], hard["l", 2, "u"], hard["r", 1, "u"]}) == 1
    h = latent.latent_histogram(cells, ["x", "y", "z"]).collect()
    assert math.isclose(sum(r.v for r in h), 3 * len(rows)) and all(math.isclose(sum(w), 1) for w in (r.weights for r in cells.collect()))


def test_factor_arithmetic(spark):
    f = factors.Factor(spark.createDataFrame([("x", 0, 2.0)], "a string, b int, v double"), {"a": ["x", "y"], "b": [0, 1]})
    g = factors.Factor(spark.createDataFrame([(0, 5.0), (1, 4.0)], "b int, v double"), {"b": [0, 1]})
    h = factors.Factor(spark.createDataFrame([("p", 3.0)], "e string, v double"), {"e": ["p", "q"]}, absent=1.0)
    value = lambda t, *names: {tuple(r[n] for n in names): r.v for r in t.dense().collect()}
    assert value(f + g, "a", "b") == {("x", 0): 7.0, ("x", 1): 4.0, ("y", 0): 5.0, ("y", 1): 4.0}
    assert value(g - f, "a", "b") == {("x", 0): 3.0, ("x", 1): 4.0, ("y", 0): 5.0, ("y", 1): 4.0}
    assert value(f * g, "a", "b") == {("x", 0): 10.0, ("x", 1): 0.0, ("y", 0): 0.0, ("y", 1): 0.0}
    assert value(g / f, "a", "b") == {("x", 0): 2.5, ("x", 1): 0.0, ("y", 0): 0.0, ("y", 1): 0.0}
    assert value(f * h, "a", "b", "e")["x", 0, "q"] == 2.0 and value(f * h, "a", "b", "e")["y", 1, "p"] == 0.0
    assert value(f.exp(), "a", "b")["y", 1] == 1.0 and value(f.log(), "a", "b")["y", 1] == float("-inf") and value(f.log().exp(), "a", "b") == value(f, "a", "b")
    assert value(f.exp().sum_out(["a"]), "a") == {("x",): math.exp(2) + 1, ("y",): 2.0}
    assert value((f + 1).log().logsumexp(["b"]), "b").keys() == {(0,), (1,)} and math.isclose(value((f + 1).log().logsumexp(["b"]), "b")[(0,)], math.log(4))
    assert value(f.condition(a="x"), "b") == {(0,): 2.0, (1,): 0.0} and value(factors.Factor.full(f.cells, f.domain, 7.0), "a", "b")["y", 0] == 7.0
    assert f.loss(f + 1).first().loss == 2.0 and f.dot(g).first().dot == 10.0
    with pytest.raises(ValueError):
        f + factors.Factor(g.cells, {"b": [0, 1, 2]})
    with pytest.raises(ValueError):
        factors.Factor(f.cells, f.domain, limit=3).exp().dense()
