"""Group queries against brute force: batches, null values, repeated rows, groups without a parent."""

from kinweave.operators.workload import GroupQuery, answer, random_queries, shapes

PARENTS = [(k, "abc"[k % 3] if k % 7 else None) for k in range(60)]
CHILDREN = [(k % 65, "xyz"[(k * k) % 3] if k % 11 else None, k % 4) for k in range(300)] + [(1, "x", 0)] * 500 + [(None, "x", 1)]


def _brute(q):
    met = lambda sets, row: all(row[a] in v for a, v in sets.items())
    n = 0
    for k, kind in PARENTS:
        rows = [{"f": f, "g": g} for p, f, g in CHILDREN if p == k]
        if not rows or not q.low <= len(rows) < q.high or not met(q.parent, {"kind": kind}):
            continue
        ok = all(any(met(m, r) for r in rows) for m in q.members)
        if len(q.members) == 2:
            ok = ok and sum(met(q.members[0], r) or met(q.members[1], r) for r in rows) > 1
        n += ok
    return n


def _tables(spark):
    return spark.createDataFrame(PARENTS, "pk long, kind string"), spark.createDataFrame(CHILDREN, "fk long, f string, g int")


def test_answers_equal_brute_force_in_one_batch_and_in_many(spark):
    p, c = _tables(spark)
    values = {"kind": ["a", "b", "c"]}, {"f": ["x", "y", "z"], "g": [0, 1, 2, 3]}
    queries = [*random_queries(6, *values, 6, 1), *(GroupQuery(f"r{q.name}", q.parent, q.members, q.low, q.high) for q in random_queries(6, *values, 6, 2, seed=3))]
    queries += [GroupQuery("all"), GroupQuery("twice", {}, ({"f": ("x",), "g": (0,)}, {"f": ("x",)}), 1, 1000), GroupQuery("large", {"kind": ("b",)}, ({"f": ("x",)},), 100)]
    expected = {q.name: _brute(q) for q in queries}
    for batch in (60, 4):
        assert {r.query: r.n for r in answer(p, "pk", c, "fk", queries, batch).collect()} == expected
    assert expected["large"] == 1


def test_groups_of_one_shape_are_one_row_and_a_hot_group_is_short(spark):
    p, c = _tables(spark)
    found = shapes(p, "pk", c, "fk", [GroupQuery("q", {}, ({"f": ("x",)},))]).collect()
    assert sum(r.n_groups for r in found) == 60 and len(found) < 60
    assert max(r["size"] for r in found) > 500 and max(len(r._members) for r in found) <= 4
