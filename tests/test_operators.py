"""Worked examples and invariants of the relational operators."""

import json
import math
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import columns as C
from kinweave.operators import factors, groups, marginals, permute, privacy, sampling, structure, workload
from kinweave.operators.match import match
from kinweave.sources import tables


def cells(df, *keys):
    return {tuple(r[k] for k in keys): round(r["v"], 9) for r in df.collect()}


@pytest.fixture(scope="module")
def three(spark):
    """Groups [a], [a, b], [a, a, b]."""
    data = [(1, "a", 0), (2, "a", 0), (2, "b", 1), (3, "a", 0), (3, "a", 1), (3, "b", 2)]
    return permute.numbered(spark.createDataFrame(data, "g int, x string, o int"), "g", [F.col("o")], 9)


def test_pairs_of_members(three):
    got = cells(permute.permutation_marginal(three, "g", ["x"], 2), "n", "m0_x", "m1_x")
    third = round(1 / 3, 9)
    assert got == {(1, "a", "a"): 1, (2, "a", "b"): 0.5, (2, "b", "a"): 0.5, (3, "a", "a"): third, (3, "a", "b"): third, (3, "b", "a"): third}


def test_triples_repeat_the_first_member(three):
    got = cells(permute.permutation_marginal(three, "g", ["x"], 3), "n", "m0_x", "m1_x", "m2_x")
    third = round(1 / 3, 9)
    assert got == {(1, "a", "a", "a"): 1, (2, "a", "b", "a"): 0.5, (2, "b", "a", "b"): 0.5, (3, "a", "a", "b"): third, (3, "a", "b", "a"): third, (3, "b", "a", "a"): third}


def test_fewer_slots_are_a_projection_of_more(three):
    two = permute.permutation_marginal(three, "g", ["x"], 3).groupBy("n", "m0_x").agg(F.sum("v").alias("v"))
    assert cells(two, "n", "m0_x") == cells(permute.permutation_marginal(three, "g", ["x"], 1), "n", "m0_x")


@pytest.fixture(scope="module")
def sized(spark):
    data = [(g, k) for g, n in enumerate([1, 1, 2, 3, 3, 3, 5]) for k in range(n)]
    return spark.createDataFrame(data, "g int, k int")


def test_sizes(sized):
    assert {r["size"]: r.n_groups for r in groups.size_histogram(sized, "g", 3).collect()} == {1: 2, 2: 1, 3: 4}
    assert [r.v for r in groups.size_quantiles(sized, "g", (0.25, 0.5, 0.9)).orderBy("q").collect()] == pytest.approx([1.5, 3, 3.8])
    assert groups.mass_quantile(groups.size_histogram(sized, "g"), 0.5).first()["size"] == 3


def test_score_and_information(spark):
    df = spark.createDataFrame([("p", "x")] * 30 + [("p", "y")] * 10 + [("q", "x")] * 20 + [("q", "y")] * 40, "a string, b string")
    joint = marginals.pair_counts(df, ["a", "b"])
    assert marginals.r_scores(joint).first().score == pytest.approx(20.0)
    assert marginals.mutual_information(joint).first().mi == pytest.approx(0.0863046217)
    assert marginals.entropy(marginals.marginal(df, ["a", "b"])).first().h == pytest.approx(1.2798542258)


def test_score_counts_pairs_that_never_occur(spark):
    df = spark.createDataFrame([("p", "x")] * 5 + [("q", "y")] * 5, "a string, b string")
    assert marginals.r_scores(marginals.pair_counts(df, ["a", "b"])).first().score == pytest.approx(5.0)


def test_merge_and_back(spark):
    m = spark.createDataFrame([(1, "x", 4.0), (2, "x", 2.0), (2, "y", 1.0), (3, "x", 3.0), (3, "y", 2.0)], "size long, k string, v double")
    h = spark.createDataFrame([(1, 4), (2, 3), (3, 5)], "size long, n_groups long")
    merged = marginals.merge_sizes(m, ["k"], 2)
    assert cells(merged, "size", "k") == {(1, "x"): 4, (2, "x"): 5, (2, "y"): 3}
    assert cells(marginals.unmerge_sizes(merged, ["k"], 2, h), "size", "k") == {(1, "x"): 4, (2, "x"): 1.875, (2, "y"): 1.125, (3, "x"): 3.125, (3, "y"): 1.875}


def test_normalise_and_legalise(spark):
    m = spark.createDataFrame([(0, "x", 1.0), (2, "x", 2.4), (2, "y", 1.6), (3, "x", -1.0)], "size long, k string, v double")
    h = spark.createDataFrame([(0, 9), (2, 3), (3, 5)], "size long, n_groups long")
    assert cells(marginals.normalise_by_size(m, h), "size", "k") == {(0, "x"): 0, (2, "x"): 1.8, (2, "y"): 1.2, (3, "x"): 0}
    assert cells(marginals.legalise(m, 1), "size", "k")[2, "x"] == 2.4
    assert cells(marginals.legalise(m, 2), "size", "k")[2, "x"] == 0


def test_distance(spark):
    a, b = (spark.createDataFrame(list(zip("xy", v, strict=True)), "k string, v double") for v in ([4.0, 6.0], [5.0, 5.0]))
    assert tuple(marginals.tvd(a, b, ["k"]).first()) == pytest.approx((1, 0.1))
    assert marginals.tvd(a.withColumn("v", F.lit(0.0)), b, ["k"]).first().ratio == 1


def test_dense_marginal_is_bounded(spark):
    m = spark.createDataFrame([(1, 1, 2.0), (2, 2, 3.0)], "a int, b int, v double")
    values = {"a": m.select("a"), "b": m.select("b")}
    assert cells(marginals.densify(m, values), "a", "b") == {(1, 1): 2, (1, 2): 0, (2, 1): 0, (2, 2): 3}
    with pytest.raises(ValueError):
        marginals.densify(m, values, 3)


def test_errors(spark):
    t, s = spark.createDataFrame([("a", 10), ("b", 4)], "k string, n int"), spark.createDataFrame([("a", 12)], "k string, n int")
    assert workload.sql_error(t, s, ["k"], "n").first().error == pytest.approx(0.6, abs=1e-6)
    q = lambda n: spark.createDataFrame([("q", n)], "query string, n int")
    assert workload.query_errors(q(20), q(9), 100, 50, 0.01).first().error == pytest.approx(0.1)


def test_two_members_have_to_be_distinct(spark):
    parent, child = spark.createDataFrame([(1,), (2,)], "p int"), spark.createDataFrame([(1, "r"), (1, "s"), (2, "r"), (2, "r")], "f int, x string")
    q = workload.GroupQuery("q", {}, ({"x": ("r",)}, {"x": ("r",)}))
    assert workload.answer(parent, "p", child, "f", [q]).first().n == 1


def test_dates(spark):
    df = spark.createDataFrame([(4, 1, 29), (5, 1, 28), (3, 3, 30), (4, 1, 28)], "y int, m int, d int")
    assert [str(r[0]) for r in df.select(C.date_of(F.col("y"), F.col("m"), F.col("d"))).collect()] == ["1996-02-28", "1997-02-28", "1995-04-28", "1996-02-29"]
    got = spark.createDataFrame([(70,), (-5,)], "x int").select(C.quotient(F.col("x"), 11), C.remainder(F.col("x"), 11)).collect()
    assert [tuple(r) for r in got] == [(6, 4), (-1, 6)]


def test_codes(spark):
    df = spark.createDataFrame([(0.07, 900.0, -999.99), (0.1, 2050.0, -1500.0), (0.0, 0.0, 12000.0)], "d double, p double, b double")
    got = [tuple(r) for r in df.select(C.discount_code(F.col("d")), C.retail_code(F.col("p")), C.balance_code(F.col("b"))).collect()]
    assert got == [(7, 45, 0), (10, 99, 10), (0, 0, 109)]


def test_wide_dictionary_equals_the_plain_one(spark):
    df = spark.createDataFrame([(f"v{k * 7 % 50:03d}",) for k in range(200)], "x string")
    assert sorted(C.dictionary(df, "x").collect()) == sorted(C.wide_dictionary(df, "x").collect())


def test_budget_and_sigma():
    assert privacy.sigma(2, 0.25) == 4
    for e, x in ((3.2, 0.57932217), (0.8, 0.04782366), (0.2, 0.00376188), (0.1, 0.00105760)):
        assert privacy.privacy_budget(e, 1e-5) == pytest.approx(x, abs=1e-8)
    assert privacy.delta_of(0.421, 3.2) == pytest.approx(2.352e-7, rel=1e-3)
    ledger = privacy.Ledger(1.0, {"a": 0.5, "b": 0.5})
    ledger.charge("a", 0.5)
    with pytest.raises(ValueError):
        ledger.charge("a", 0.1)


def test_cfs_and_graphs():
    score = {frozenset("tu"): 0.3, frozenset("tv"): 0.2, frozenset("uv"): 0.1}
    assert structure.cfs_score("t", ["u", "v"], score) == pytest.approx(0.5 / math.sqrt(4.2))
    square = structure.graph_of(list("abcd"), [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")])
    cliques = structure.maximal_cliques(structure.triangulated(square))
    assert sorted(map(len, cliques)) == [3, 3]
    assert structure.junction_tree(cliques) == [(0, 1)]
    grown = structure.grow_graph(dict.fromkeys("abc", 10), [("a", "b", 3.0), ("b", "c", 2.0), ("a", "c", 1.0)], 100, 1000)
    assert grown == {"a": {"b"}, "b": {"a", "c"}, "c": {"b"}}
    assert structure.schedule(7, 3) == [3, 2, 2]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=6), st.integers(0, 40))
def test_rounding_sums_up(spark, weights, n):
    p = spark.createDataFrame([("g", k, float(w), n) for k, w in enumerate(weights)], "g string, k int, v double, n int")
    got = {r.k: r.n_drawn for r in sampling.random_round(p, ["g"], "k", "n", F.concat_ws("|", "g", "k")).collect()}
    assert sum(got.values()) == n
    total = sum(weights)
    for k, w in enumerate(weights):
        share = n * (w / total if total else 1 / len(weights))
        assert math.floor(share + 1e-9) <= got[k] <= math.ceil(share - 1e-9) + 1


def test_fill_keeps_the_rounded_counts(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    w = spark.createDataFrame([(g, v, float(v + 1)) for g in range(3) for v in range(3)], "g long, x int, v double")
    out = sampling.conditional_fill(rows, ["g"], "k", w, "x")
    assert out.count() == 100 and out.select("k").distinct().count() == 100
    assert {(r.g, r.x): r["count"] for r in out.groupBy("g", "x").count().collect()}[0, 2] in (17, 18)


def test_matching_is_one_to_one(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (3, "y", 1), (4, "z", 5)], "i int, c string, d int")
    b = spark.createDataFrame([(10, "x", 2), (11, "x", 9), (12, "y", 1), (13, "w", 5)], "j int, c string, d int")
    got = match(a, b, ["c", "d"], "i", "j").collect()
    assert sorted(r.i for r in got) == [1, 2, 3, 4] and sorted(r.j for r in got) == [10, 11, 12, 13]
    assert {(r.i, r.j): r.agreed for r in got} == {(1, 11): 1, (2, 10): 2, (3, 12): 2, (4, 13): 1}


def test_propagation_equals_brute_force(spark):
    f = {"ab": {(a, b): 1.0 + a + 2 * b for a, b in product(range(2), range(3))}, "bc": {(b, c): 2.0 + b * c for b, c in product(range(3), range(2))}}
    dfs = {k: spark.createDataFrame([(*c, v) for c, v in t.items()], f"{k[0]} int, {k[1]} int, v double") for k, t in f.items()}
    got = cells(factors.tree_marginals(dfs, [("ab", "bc")])["bc"], "b", "c")
    assert got == {(b, c): round(sum(f["ab"][a, b] for a in range(2)) * f["bc"][b, c], 9) for b, c in product(range(3), range(2))}
    e = factors.logsumexp(dfs["ab"], ["a"])
    assert cells(e, "a")[0,] == pytest.approx(math.log(sum(math.exp(f["ab"][0, b]) for b in range(3))))


def test_sources(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|a|x|\n2|b|y|\n")
    df = tables.read_tbl(spark, str(tmp_path / "t.tbl"), "K_KEY int, v string, note string", ("note",))
    assert [tuple(r) for r in df.orderBy("K_KEY").collect()] == [(1, "a"), (2, "b")]
    assert tables.lower_names(df).dtypes == [("k_key", "bigint"), ("v", "string")]
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "K_KEY int, v string").count() == 2
    tables.write_domain(str(tmp_path / "d.json"), {"a": 3, "b": 5}, {"b"})
    assert tables.read_domain(str(tmp_path / "d.json"), ["b", "a"]) == {"b": 5, "a": 3}
    assert json.loads((tmp_path / "d.json").read_text())["b"]["type"] == "continuous"
    (tmp_path / "log").write_text("error: 0.25\nother\nerror: 3\n")
    assert sorted(r.error for r in tables.error_lines(spark, str(tmp_path / "log")).collect()) == [0.25, 3.0]
    wide = spark.createDataFrame([(1, "p", "c1", 0), (1, "p", "c2", 0), (2, "q", "c3", 1)], "h int, ha string, ia string, group_type_x int")
    parents, children, size = tables.split_denormalised(wide, "h", ["ha"], ["ia"])
    assert parents.count() == 2 and children.count() == 3 and {r.h: r["size"] for r in size.collect()} == {1: 2, 2: 1}
    keyed = spark.createDataFrame([(1, 5, 9), (1, 6, 9)], "id int, a int, fk int")
    with pytest.raises(ValueError):
        tables.read_keyed(keyed, "id", "fk", ["a"])


def test_stream_marginal(spark, tmp_path):
    from kinweave.streaming import marginals as live

    spark.sql("select timestamp '2024-01-01 00:00:10' as ts, 'a' as k union all select timestamp '2024-01-01 00:00:20', 'a' union all select timestamp '2024-01-01 01:00:00', 'b'").write.parquet(str(tmp_path / "in"))
    events = live.read_events(spark, str(tmp_path / "in"), "ts timestamp, k string")
    q = live.start(live.windowed_marginal(events, ["k"], "ts", "1 minute", "1 minute"), "live_marginal", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.k, r.v) for r in spark.table("live_marginal").collect()] == [("a", 2)]


def test_match_counts_columns_not_signs(spark):
    from kinweave.operators.match import match

    a = spark.createDataFrame([(1, "x=y=z", "/*"), (2, "/", "q")], "ka int, u string, v string")
    b = spark.createDataFrame([(7, "x=y=z", "other"), (8, "*", "q")], "kb int, u string, v string")
    assert sorted(map(tuple, match(a, b, ["u", "v"], "ka", "kb").collect())) == [(1, 7, 1), (2, 8, 1)]


def test_composition_tells_values_with_separators_apart(spark):
    from kinweave.operators.marginals import composition

    df = spark.createDataFrame([(1, "Ax1,B"), (2, "A"), (2, "B")], "g int, v string")
    assert sorted(r.n for r in composition(df, "g", "v").collect()) == [1, 1]


def test_fill_without_weights_deals_evenly(spark):
    from kinweave.operators.sampling import conditional_fill

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k int, c string")
    w = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.0)], "c string, val string, v double")
    got = {r.k: r.val for r in conditional_fill(rows, ["c"], "k", w, "val").collect()}
    assert got[1] == "x" and sorted([got[2], got[3]]) == ["x", "y"]


def test_error_lines_read_any_number(spark, tmp_path):
    from kinweave.sources.tables import error_lines

    (tmp_path / "log").write_text("error: 0.5\nerror: 1.2e-05\nerror: 3e-4\nerror: 12345678.5\nno\nerror: -\n")
    assert sorted(r.error for r in error_lines(spark, str(tmp_path / "log")).collect()) == [1.2e-05, 3e-4, 0.5, 12345678.5]


def test_domain_of_a_column_that_the_file_lacks(tmp_path):
    import pytest

    from kinweave.sources.tables import read_domain, write_domain

    write_domain(str(tmp_path / "d"), {"a": 3})
    assert read_domain(str(tmp_path / "d"), ["a"]) == {"a": 3}
    with pytest.raises(ValueError):
        read_domain(str(tmp_path / "d"), ["a", "b"])


def test_seeds_change_draws(spark):
    from pyspark.sql import functions as F

    from kinweave.operators import draws

    df = spark.range(200).withColumn("w", F.col("id") % 2)
    one = [{r.id for r in draws.fixed_subset(df, "id", 20, s).collect()} for s in (1, 1, 2)]
    assert one[0] == one[1] != one[2] and len(one[2]) == 20
    assert all(r.w for r in draws.weighted_subset(df, "id", F.col("w"), 30, 3).collect())
    sizes = sorted(r["count"] for r in draws.near_equal_parts(df, "id", 7, 5).groupBy("part").count().collect())
    assert sizes[-1] - sizes[0] <= 1 and sum(sizes) == 200
    assert [r.n for r in draws.numbered_rows(df, [-F.col("id")], "n").orderBy("id").collect()] == list(range(199, -1, -1))


def test_names_of_slots_and_projections():
    from kinweave.operators import lattice

    flat = ["city", "m3_age", "m5_age", "m3_sex"]
    assert lattice.members_of(flat) == (["city"], {3: ("age", "sex"), 5: ("age",)})
    assert lattice.canonical(flat) == {"m5_age": "m0_age", "m3_age": "m1_age", "m3_sex": "m1_sex"}
    assert lattice.canonical(["m0_age", "m4_age", "m4_sex", "city"]) == {"m0_age": "m0_age", "m4_age": "m1_age", "m4_sex": "m1_sex"}
    assert len(lattice.placements(["m0_age", "m1_sex"], 4)) == 12 and {"m0_age": "m3_age", "m1_sex": "m0_sex"} in lattice.placements(["m0_age", "m1_sex"], 4)
    assert lattice.reorderings(["m0_age", "m1_age"]) == [{"m0_age": "m0_age", "m1_age": "m1_age"}, {"m0_age": "m1_age", "m1_age": "m0_age"}]
    assert lattice.flattened_domain({"city": 3}, {"age": 5}, 2) == {"city": 3, "m0_age": 5, "m1_age": 5}
    assert lattice.placed(("city", "m0_age"), 3, [frozenset({"city", "m1_age", "m2_age"})]) == [("city", "m1_age"), ("city", "m2_age")]
    domain = {"a": 2, "b": 3, "c": 50}
    assert lattice.lattice([("a", "b", "c"), ("a", "b")], domain, 2) == {("a",): ("a", "b"), ("a", "b"): ("a", "b"), ("a", "c"): ("a", "b", "c"), ("b",): ("a", "b"), ("b", "c"): ("a", "b", "c"), ("c",): ("a", "b", "c")}


def test_codes_outside_the_lists_and_days(spark):
    from kinweave.operators import codecs

    df = spark.createDataFrame([(1, "F", 0, 0), (2, "?", 4, 0), (3, None, 3, 5), (4, "P", 2, 9)], "k int, s string, q int, r int")
    out = df.select("k", codecs.code_of("s", codecs.STATUS).alias("c"), codecs.days_of(F.col("q"), F.col("r")).alias("d"))
    back = out.select("k", codecs.name_of(F.when(F.col("c") >= 0, F.col("c")), codecs.STATUS).alias("s"), "c", "d")
    assert sorted(map(tuple, back.collect())) == [(1, "F", 0, 0), (2, None, -1, None), (3, None, -1, 30), (4, "P", 2, 29)]
    assert sorted(r[0] is None for r in out.select(codecs.name_of(F.col("c"), codecs.STATUS)).collect()) == [False, False, True, True]


def test_hierarchy_draws_only_what_exists(spark):
    from kinweave.operators import codecs

    items = spark.createDataFrame([("d1", "a", 1), ("d1", "b", 2), ("d1", "b", 3), ("d2", "c", 4)], "dep string, aisle string, item int")
    rows = spark.createDataFrame([(k, "d1" if k % 2 else "d2", k % 5) for k in range(200)], "key int, dep string, index int")
    out = codecs.fill_hierarchy(rows, "key", items, "dep", "aisle", "item").collect()
    assert len(out) == 200
    have = {tuple(r) for r in items.collect()}
    assert all((r.dep, r.aisle, r.item) in have for r in out)
    assert all(r.valid == (r.key % 5 < (2 if r.key % 2 else 1)) for r in out)
    assert all(r.aisle == "ab"[r.key % 5] for r in out if r.valid and r.dep == "d1")
