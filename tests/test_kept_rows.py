"""No row is lost to a null or an unknown value; hot contexts; members that depend on each other."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinweave.functions import columns as C
from kinweave.operators import codecs, draws, match, permute, sampling, siblings
from kinweave.operators.siblings import Draw
from kinweave.plans import synthesis


def test_codes_of_null_and_unknown_values(spark):
    codes = C.dictionary(spark.createDataFrame([("a",), ("b",)], "x string"), "x")
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "new")], "k int, x string")
    coded = C.encode(df, "x", codes)
    assert {r.k: r.x for r in coded.collect()} == {1: 1, 2: None, 3: -1}
    assert {r.k: r.x for r in C.decode(coded, "x", codes).collect()} == {1: "b", 2: None, 3: None}
    customers = spark.createDataFrame([(1, 2, 3.0, None), (2, 2, 3.0, "A")], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    segments = C.dictionary(customers.filter("c_mktsegment = 'A'"), "c_mktsegment")
    assert {r.c_custkey: r.segment for r in codecs.encode_customer(customers, segments).collect()} == {1: None, 2: 0}
    assert codecs.decode_customer(codecs.encode_customer(customers, segments), segments).count() == 2


def test_hierarchy_with_unknown_upper_names(spark):
    items = spark.createDataFrame([("u", "a", 1), ("u", "b", 2), ("v", "c", 3), (None, "d", 4)], "upper string, lower string, item int")
    rows = spark.createDataFrame([(1, "u", 0), (2, "u", 9), (3, "none", 0), (4, None, 0)], "key int, upper string, index int")
    got = {r.key: r for r in codecs.fill_hierarchy(rows, "key", items, "upper", "lower", "item").collect()}
    assert (got[1].lower, got[1].item, got[1].valid) == ("a", 1, True) and got[2].lower in ("a", "b") and not got[2].valid
    assert [(got[k].lower, got[k].item, got[k].valid) for k in (3, 4)] == [(None, None, False)] * 2


def test_conditional_keep_with_null_keys(spark):
    df = spark.createDataFrame([(1, 5), (1, 1), (None, 5), (None, None), (2, 1)], "fk int, x int")
    kept = draws.keep_where_any(df, "fk", F.col("x") == 5, F.col("x") > 2)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, 5), (None, 5), (2, 1)], key=repr)


def test_fill_with_null_and_hot_contexts(spark):
    rows = spark.createDataFrame([(k, None if k % 10 == 0 else "hot" if k % 10 < 9 else "bare") for k in range(1000)], "k int, c string").repartition(5)
    weights = spark.createDataFrame([(None, "x", 3.0), (None, "y", 1.0), ("hot", "x", 1.0), ("hot", "y", 1.0), ("hot", "z", 2.0)], "c string, v0 string, v double").withColumnRenamed("v0", "val")
    got = sampling.conditional_fill(rows, ["c"], "k", weights, "val")
    counts = Counter((r.c, r.val) for r in got.collect())
    assert counts == {(None, "x"): 75, (None, "y"): 25, ("hot", "x"): 200, ("hot", "y"): 200, ("hot", "z"): 400} | {("bare", v): counts["bare", v] for v in "xyz"}
    assert sorted(counts["bare", v] for v in "xyz") == [33, 33, 34]
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan.split("Physical Plan")[-1] or "md5" not in plan.split("Physical Plan")[-1].split("Window")[1][:200]
    drawn = sampling.inverse_cdf(rows, ["c"], F.col("k"), spark.createDataFrame([(None, "x", 1), ("hot", "z", 5), ("hot", "q", 0)], "c string, val string, n long"), "val")
    assert Counter((r.c, r.val) for r in drawn.collect()) == {(None, "x"): 100, ("hot", "z"): 800, ("bare", None): 100}


def test_matching_of_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "ka int, c string")
    b = spark.createDataFrame([(7, "x"), (8, None), (9, "z")], "kb int, c string")
    assert {(r.ka, r.kb, r.agreed) for r in match.match(a, b, ["c"], "ka", "kb").collect()} == {(1, 8, 1), (2, 7, 1), (3, 9, 0)}


def test_ranks_of_ties_and_text(spark):
    df = spark.createDataFrame([(i, "same") for i in range(60)], "id int, x string").repartition(4)
    assert sorted(r.n for r in draws.numbered_rows(df, [F.col("x")], "n").collect()) == list(range(60))


def test_copies_of_one_row_are_dealt_out_to_tasks(spark):
    n = 5 * 8 * sampling.BLOCK + 1
    counts = spark.createDataFrame([("a", n), ("b", 3), ("c", 0), ("d", None)], "k string, n long")
    got = sampling.expand(counts, "n")
    assert got.columns == ["k", "n", "copy"]
    by_task = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(by_task) == 6 and max(r["count"] for r in by_task) < n / 3
    per = {r.k: tuple(r)[1:] for r in got.groupBy("k").agg(F.count("copy"), F.count_distinct("copy"), F.min("copy"), F.max("copy")).collect()}
    assert per == {"a": (n, n, 1, n), "b": (3, 3, 1, 3)}


def looked_at_again(df):
    """What a look at df's rows has to count or rank again."""
    return [n for n in ("Aggregate", "Window") if n in df._jdf.queryExecution().optimizedPlan().toString()]


def test_filled_columns_and_new_tables_are_not_counted_again(spark):
    """Else each column that follows counts the rows of all before, and fresh noise differs from look to look."""
    rng = random.Random(8)
    rows = spark.createDataFrame([(str(i), rng.choice("pq")) for i in range(200)], "key string, k string")
    weights = spark.createDataFrame([("p", "x", 1.0), ("p", "y", 3.0), ("q", "x", 1.0)], "k string, v string, w double").withColumnRenamed("w", "v2")
    filled = sampling.conditional_fill(rows, ["k"], "key", weights.select("k", F.col("v").alias("value"), F.col("v2").alias("v")), "value")
    assert looked_at_again(filled) == []
    n = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    got = {(r.k, r.value): r["count"] for r in filled.groupBy("k", "value").count().collect()}
    assert got[("q", "x")] == n["q"] and sum(x for (k, _), x in got.items() if k == "p") == n["p"] and abs(got[("p", "y")] - 0.75 * n["p"]) < 1
    orders = spark.createDataFrame([(i, rng.choice("PQ")) for i in range(400)], "pk long, p string")
    lines = spark.createDataFrame([(i, j, rng.choice("AB")) for i in range(400) for j in range(rng.randrange(1, 5))], "fk long, j int, a string")
    parents, children = synthesis.synthesise(orders, "pk", ["p"], lines, "fk", ["a"], 50.0, 4)
    assert looked_at_again(parents) == looked_at_again(children) == []
    keys, of = {r.pk: r.p for r in parents.collect()}, Counter(r.fk for r in children.collect())
    assert set(of) == set(keys) and None not in keys.values()
    assert all(of[k] == int(k.split("-")[0]) for k in keys)
    assert {r.a for r in children.select("a").distinct().collect()} == {"A", "B"}
    assert abs(len(keys) - 400) < 40


def test_draws_take_whole_products(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(1 << 32), rng.randrange(1 << rng.randrange(1, 63))) for _ in range(500)] + [((1 << 32) - 1, (1 << 62) - 1), (0, 1), ((1 << 32) - 1, (1 << 32) - 1)]
    got = spark.createDataFrame(pairs, "u long, t long").select("u", "t", sampling._part(F.col("u"), F.col("t")).alias("x")).collect()
    assert all(r.x == r.u * r.t >> 32 for r in got)


@pytest.mark.parametrize("most", [None, 3])
def test_drawn_values_are_those_of_the_steps(spark, most):
    weights = [("p", "x", 3), ("p", None, 5), ("p", "z", 2), ("q", "y", 7), (None, "x", 1)]
    w = spark.createDataFrame(weights, "k string, v string, n long")
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["p", "q", None, "r"] * 50)], "k string, i long")
    got = {r.i: r.v for r in sampling.inverse_cdf(rows, ["k"], F.col("i"), w, "v", most).collect()}
    for i, k in enumerate(["p", "q", None, "r"] * 50):
        steps = sorted((x for x in weights if x[0] == k), key=lambda x: (x[1] is not None, x[1] or ""))
        place = int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) * sum(x[2] for x in steps) >> 32
        upto, want = 0, None
        for _, v, n in steps:
            if upto <= place < upto + n:
                want = v
            upto += n
        assert got[i] == want


# ---- siblings ----------------------------------------------------------------------------------


def test_groups_by_kind_give_the_marginals_of_all_groups(spark):
    rng = random.Random(6)
    child = [(g, i, rng.choice(["A", "B", None]), rng.choice("xy")) for g in range(300) for i in range(rng.randrange(1, 5))]
    parent = spark.createDataFrame([(g, rng.choice(["P", None])) for g in range(290)], "pk int, p string")
    members = permute.numbered(spark.createDataFrame(child, "fk int, i int, a string, b string"), "fk", [F.col("i")], 4).select("fk", "rn", "n", "a", "b")
    by_kind, parents = siblings.kinds(siblings.gathered(members, "fk", ["a", "b"]).join(parent.withColumnRenamed("pk", "fk"), "fk"), ["a", "b"], ["p"])
    assert parents.agg(F.sum("groups")).first()[0] == 290 > parents.count()
    key = ["p", "n", "m0_a", "m0_b", "m1_a", "m1_b"]

    def marginal(table, weight):
        return {tuple(r)[:-1]: round(r.v, 9) for r in table.filter("n > 1").groupBy(*key).agg(F.sum(weight).alias("v")).collect()}

    want = marginal(permute.permutations(members, "fk", ["a", "b"], 2).join(parent.withColumnRenamed("pk", "fk"), "fk"), F.col("weight"))
    assert marginal(permute.permutations(by_kind, "kind", ["a", "b"], 2).join(parents, "kind"), F.col("weight") * F.col("groups")) == want


# ---- siblings: planning and drawing --------------------------------------------------------------


def test_planning_takes_own_columns_and_few_members():
    domain = {"p": 3, "a": 4, "b": 2, "size": 5}
    scores = {frozenset(x): s for x, s in [(("m0_a", "m1_a"), 9.0), (("m0_a", "m0_b"), 5.0), (("m1_a", "m1_b"), 5.0), (("p", "m0_a"), 1.0), (("p", "m1_a"), 1.0), (("m0_b", "m1_b"), 2.0)]}
    plan = siblings.plan(scores, ["p"], ["a", "b"], 5, domain, most=4, limit=2000)
    assert [d.target for d in plan][:3] == ["p", "m0_a", "m0_b"] and len(plan) == 11
    for d in plan:
        assert len({siblings.slot_of(c) for c in d.given} - {-1, d.slot}) <= 2 and len(d.given) <= 4
        assert sum(siblings.slot_of(c) == d.slot >= 0 for c in d.given) <= 2
    last = {d.target: d for d in plan}
    assert last["m4_b"].given[0] == "m4_a" and last["m4_a"].given[:2] == ("m3_a", "m2_a")
    assert siblings.canonical(["m2_a", "p", "m4_b"]) == {"m2_a": "m0_a", "p": "p", "m4_b": "m1_b"}


def test_members_resemble_each_other(spark):
    """Groups whose members share a value nine times in ten: drawn with regard to other members the distance of
    pairs is small, alone it is that of independence; without given draws the plan finds the dependence."""
    rng = random.Random(2)
    parents, children = [], []
    for g in range(3000):
        parents.append((g, rng.choice("PQ")))
        common = rng.choice("ABC")
        children += [(g, i, common if rng.random() < 0.9 else rng.choice("ABC"), rng.choice("xy")) for i in range(rng.randrange(1, 6))]
    parent = spark.createDataFrame(parents, "pk int, p string")
    child = spark.createDataFrame(children, "fk int, i int, a string, b string")
    values = {"p": ["P", "Q"], "a": ["A", "B", "C"], "b": ["x", "y"]}
    make = lambda draws: siblings.synthesise(child, "fk", ["a", "b"], parent, "pk", ["p"], values, [F.col("i")], 4, 3.2, draws, seed=11)
    members = permute.numbered(child, "fk", [F.col("i")], 4)
    truth = {(r.m0_a, r.m1_a): r.v for r in siblings.pair_shares(members, "fk", "a").collect()}

    def distance(wide):
        rows = siblings.member_rows(wide, ["a", "b"], 4)
        got = {(r.m0_a, r.m1_a): r.v for r in siblings.pair_shares(rows, "group", "a").collect()}
        return sum(abs(truth.get(k, 0) - got.get(k, 0)) for k in truth.keys() | got.keys()) / 2, rows

    wide, draws_found = make(None)
    together, rows = distance(wide)
    alone, _ = distance(make([Draw("p", ()), *[Draw(f"m{t}_{x}", ()) for t in range(4) for x in "ab"]])[0])
    assert together < 0.06 and alone > 0.4
    assert all(any(siblings.slot_of(c) not in (-1, d.slot) for c in d.given) for d in draws_found if d.target in ("m1_a", "m2_a", "m3_a"))
    by_group = defaultdict(list)
    for r in rows.collect():
        by_group[r.group].append(r)
    assert all(len(x) == x[0].n and all(r.a and r.b for r in x) for x in by_group.values())
    sizes = Counter(min(n, 4) for n in Counter(r[0] for r in children).values())
    drawn = Counter(len(x) for x in by_group.values())
    assert all(abs(sizes[n] - drawn[n]) < 0.05 * sizes[n] for n in sizes)
    own, keyed = siblings.keyed_tables(wide, ["p"], ["a", "b"], 4, 5)
    assert sorted(r.key for r in own.collect()) == list(range(len(by_group)))
    assert sorted(r.child_key for r in keyed.collect()) == list(range(sum(drawn[n] * n for n in drawn)))
