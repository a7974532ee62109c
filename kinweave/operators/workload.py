"""Group queries: parents whose group holds members that satisfy predicates; and their errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.sources.scratch import saved


@dataclass(frozen=True)
class GroupQuery:
    """Parents within `parent` sets whose size is in [low, high) and whose group has distinct members
    that satisfy the `members` predicates (one or two)."""

    name: str
    parent: dict[str, tuple] = field(default_factory=dict)
    members: tuple[dict[str, tuple], ...] = ()
    low: int = 0
    high: int = 1 << 30


def _within(sets: dict[str, tuple], of=F.col) -> Column:
    out = F.lit(True)
    for a, values in sets.items():
        out = out & of(a).isin(*values)
    return out


def _holds(q: GroupQuery) -> Column:
    """Over a group's shape: one member needs one row; two distinct ones need a row for each, and two
    rows in all."""
    of = lambda x, m: _within(m, lambda a: x[a])
    ok = F.lit(True)
    for m in q.members:
        ok = ok & (F.size(F.filter("_members", lambda x: of(x, m))) > 0)  # noqa: B023, the lambda is called here
    if len(q.members) == 2:
        either = F.filter("_members", lambda x: of(x, q.members[0]) | of(x, q.members[1]))
        ok = ok & ((F.size(either) > 1) | F.exists(either, lambda x: x["_copies"] > 1))
    return ok & (F.col("size") >= q.low) & (F.col("size") < q.high) & _within(q.parent)


def shapes(parent: DataFrame, pk: str, child: DataFrame, fk: str, queries: list[GroupQuery]) -> DataFrame:
    """Groups by all that the queries ask of them: the parent's attributes, size, and `_members`, the distinct
    combinations of the members' attributes, each with whether it occurs once or more often; n_groups of each
    shape. A list is bounded by the attributes' domain, however large the group. Groups without a parent and
    parents without a group are left out."""
    mine = sorted({a for q in queries for m in q.members for a in m})
    theirs = sorted({a for q in queries for a in q.parent})
    rows = child.groupBy(F.col(fk).alias("_group"), *[F.col(a).alias(f"_m_{a}") for a in mine]).agg(F.count(F.lit(1)).alias("_n"))
    member = F.struct(*[F.col(f"_m_{a}").alias(a) for a in mine], F.least("_n", F.lit(2)).cast("int").alias("_copies"))
    groups = rows.groupBy("_group").agg(F.sum("_n").alias("size"), F.array_sort(F.collect_list(member)).alias("_members"))
    parents = parent.select(F.col(pk).alias("_group"), *theirs)
    return groups.join(parents, "_group").groupBy(*theirs, "size", "_members").agg(F.count(F.lit(1)).alias("n_groups"))


def answer(parent: DataFrame, pk: str, child: DataFrame, fk: str, queries: list[GroupQuery], batch: int = 60) -> DataFrame:
    """(query, n): the child is read and shuffled once, for all queries. Groups of one shape are counted
    together; each batch of queries is a row of conditional sums over the shapes, which are written first where
    there is more than one batch."""
    out, found = None, shapes(parent, pk, child, fk, queries)
    if len(queries) > batch:
        found = saved(found)
    for at in range(0, len(queries), batch):
        part = queries[at : at + batch]
        counts = found.agg(*[F.sum(F.when(_holds(q), F.col("n_groups")).otherwise(0)).cast("long").alias(q.name) for q in part])
        rows = counts.select(F.explode(F.array(*[F.struct(F.lit(q.name).alias("query"), F.coalesce(F.col(q.name), F.lit(0)).alias("n")) for q in part])).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def random_queries(n: int, parent_values: dict[str, list], member_values: dict[str, list], largest: int, members: int = 1, selectivity: float = 0.2, seed: int = 0) -> list[GroupQuery]:
    """n random queries: for each attribute a random subset of its values, and a range of sizes."""
    rng, out = Random(seed), []
    draw = lambda v: tuple(sorted(rng.sample(v, max(1, round(len(v) * selectivity ** 0.5)))))
    for k in range(n):
        low = rng.randint(1, largest)
        p, m = rng.choice(sorted(parent_values)), sorted(member_values)
        out.append(GroupQuery(f"q{k:05d}", {p: draw(parent_values[p])}, tuple({(a := rng.choice(m)): draw(member_values[a])} for _ in range(members)), low, low + max(1, largest // 2)))
    return out


def query_errors(true: DataFrame, synthetic: DataFrame, groups_true: float, groups_synthetic: float, base: float) -> DataFrame:
    """(query, error): |c1 - c2 * g1 / g2| / max(base * g1, c1)."""
    j = true.withColumnRenamed("n", "c1").join(synthetic.withColumnRenamed("n", "c2"), "query")
    return j.select("query", (F.abs(F.col("c1") - F.col("c2") * (groups_true / groups_synthetic)) / F.greatest(F.lit(base * groups_true), F.col("c1"))).alias("error"))


def sql_error(true: DataFrame, synthetic: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: the mean over the true keys of |x - y| / (x + 1e-6), 1 for a missing key."""
    j = true.select(*keys, F.col(value).alias("x")).join(synthetic.select(*keys, F.col(value).alias("y")), keys, "left")
    return j.agg(F.avg(F.coalesce(F.abs(F.col("x") - F.col("y")) / (F.col("x") + 1e-6), F.lit(1.0))).alias("error"))


def averaged(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """Means over repetitions of an experiment."""
    return results.groupBy(*by).agg(F.avg(value).alias(value))
