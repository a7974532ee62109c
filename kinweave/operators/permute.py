"""Pairs and ordered permutations of a group's members, and marginals over them.

A marginal of j member slots over k-permutations equals the one over j-permutations with weight
1 / P(n, j), because a uniform k-permutation starts with a uniform j-permutation. So a marginal joins
only as many members as it has slots, and aggregates them as they come: no permutation is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.columns import md5_int


def numbered(child: DataFrame, fk: str, order: list[Column], cap: int) -> DataFrame:
    """Up to cap members of each group with rn (from 1) and n, the group's size after the cap."""
    w = Window.partitionBy(fk)
    c = child.withColumn("rn", F.row_number().over(w.orderBy(*order))).filter(F.col("rn") <= cap)
    return c.withColumn("n", F.count(F.lit(1)).over(w).cast("long"))


def pairs(members: DataFrame, fk: str, attrs: list[str], both: bool = False) -> DataFrame:
    """Unordered pairs of members (or both directions): fk, rn_a, rn_b, a_*, b_*."""
    a = members.select(fk, F.col("rn").alias("rn_a"), *[F.col(x).alias(f"a_{x}") for x in attrs])
    b = members.select(fk, F.col("rn").alias("rn_b"), *[F.col(x).alias(f"b_{x}") for x in attrs])
    return a.join(b, fk).filter(F.col("rn_a") != F.col("rn_b") if both else F.col("rn_a") < F.col("rn_b"))


def unranked(k: Column) -> tuple[Column, Column]:
    """The k-th (from 0) of the pairs (1, 2), (1, 3), (2, 3), (1, 4), ...; the root of a large k may be off by one."""
    b = F.floor((1 + F.sqrt(1 + 8 * k.cast("double"))) / 2)
    b = F.when(b * (b - 1) / 2 > k, b - 1).when(b * (b + 1) / 2 <= k, b + 1).otherwise(b)
    return (k - b * (b - 1) / 2 + 1).cast("int"), (b + 1).cast("int")


def _part(u: Column, total: Column) -> Column:
    """floor(u * total / 2^32), for products beyond a long."""
    return F.call_function("div", u.cast("decimal(20,0)") * total.cast("decimal(18,0)"), F.lit(4294967296).cast("decimal(20,0)"))


def capped_pairs(members: DataFrame, fk: str, attrs: list[str], most: int) -> DataFrame:
    """Pairs of members of each group with weight n / (pairs taken): all of them where there are at most `most`,
    else `most` drawn with replacement. Pair numbers are drawn and turned into members, which are looked up:
    work grows with the pairs taken, not with the square of a group."""
    sizes = members.filter("rn = 1").select(fk, "n").filter("n > 1")
    total = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    drawn = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: _part(md5_int(F.concat_ws("-", F.col(fk).cast("string"), i.cast("string"))), F.col("_total")))
    numbers = F.when(F.col("_total") <= most, F.sequence(F.lit(0).cast("long"), F.col("_total") - 1)).otherwise(drawn)
    p = sizes.withColumn("_total", total).select(fk, (F.col("n") / F.least(F.lit(most), F.col("_total"))).alias("weight"), F.explode(numbers).alias("_k"))
    a, b = unranked(F.col("_k"))
    p = p.withColumns({"rn_a": a, "rn_b": b}).drop("_k")
    for side in "ab":
        p = p.join(members.select(fk, F.col("rn").alias(f"rn_{side}"), *[F.col(x).alias(f"{side}_{x}") for x in attrs]), [fk, f"rn_{side}"])
    return p.select(fk, "rn_a", "rn_b", *[f"{side}_{x}" for side in "ab" for x in attrs], "weight")


def ranked_pairs(members: DataFrame, fk: str, attrs: list[str], most: int) -> DataFrame:
    """At most `most` pairs of each group, those with the smallest hashes of all its pairs, each with weight
    n / (pairs kept): no pair twice, unlike `capped_pairs`, for groups whose pairs may all be made."""
    p = pairs(members, fk, attrs).join(members.filter("rn = 1").select(fk, "n"), fk)
    key = F.concat_ws("-", F.col(fk).cast("string"), F.col("rn_a").cast("string"), F.col("rn_b").cast("string"))
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy(fk).orderBy(md5_int(key), "rn_a", "rn_b"))).filter(F.col("_r") <= most)
    kept = F.least(F.lit(most), F.col("n") * (F.col("n") - 1) / 2)
    return p.withColumn("weight", F.col("n") / kept).drop("_r")


def permutations(members: DataFrame, fk: str, attrs: list[str], j: int) -> DataFrame:
    """Ordered j-permutations of distinct members, weight 1 / P(n, j): fk, n, m{t}_{attr}, weight. A
    group with fewer members permutes all of them and repeats the permutation's first one."""
    slot = lambda t: members.select(fk, F.col("rn").alias(f"r{t}"), *([F.col("n")] if t == 0 else []), *[F.col(a).alias(f"m{t}_{a}") for a in attrs])
    out = slot(0).withColumn("weight", F.lit(1.0) / F.col("n"))
    for t in range(1, j):
        fresh = reduce_and([F.col(f"r{t}") != F.col(f"r{s}") for s in range(t)])
        padded = (F.col("n") <= t) & (F.col(f"r{t}") == F.col("r0"))
        out = out.join(slot(t), fk).filter(F.when(F.col("n") > t, fresh).otherwise(padded))
        out = out.withColumn("weight", F.when(F.col("n") > t, F.col("weight") / (F.col("n") - t)).otherwise(F.col("weight")))
    return out.drop(*[f"r{t}" for t in range(j)])


def reduce_and(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def permutation_marginal(members: DataFrame, fk: str, attrs: list[str], j: int, parent: DataFrame | None = None, pk: str = "", parent_attrs: tuple[str, ...] = (), size: bool = True) -> DataFrame:
    """Weighted counts over parent attributes, group size and the attributes of j members."""
    p = permutations(members, fk, attrs, j)
    if parent is not None:
        p = p.join(parent.select(F.col(pk).alias(fk), *parent_attrs), fk)
    keys = [*parent_attrs, *(["n"] if size else []), *[f"m{t}_{a}" for t in range(j) for a in attrs]]
    return p.groupBy(*keys).agg(F.sum("weight").alias("v"))
