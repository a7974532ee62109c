"""Seeded random parts of tables, row numbers, pairing by position and conditional keeps.

Draws order rows by a hash of seed and key: the same seed gives the same rows on every run and
engine, another seed independent ones. None of these are noise for privacy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.columns import md5_int
from kinweave.operators.marginals import marginal, tvd
from kinweave.operators.ordered import number_within


def draw(key: Column, seed: int) -> Column:
    """A 32-bit number from the seed and a key."""
    return md5_int(F.concat_ws("#", F.lit(str(seed)), key.cast("string")))


def fixed_subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n random rows: a top-n by draw, so tasks send n rows each at most."""
    return df.withColumn("_u", draw(F.col(key), seed)).orderBy("_u", key).limit(n).drop("_u")


def weighted_subset(df: DataFrame, key: str, weight: Column, n: int, seed: int) -> DataFrame:
    """n random rows without replacement, each next one drawn in proportion to its weight: those with the
    largest log(u) / weight (Efraimidis and Spirakis, 2006). Rows without positive weight never come."""
    u = (draw(F.col(key), seed) + F.lit(0.5)) / F.lit(4294967296.0)
    some = df.withColumn("_w", weight.cast("double")).filter("_w > 0")
    return some.withColumn("_k", F.log(u) / F.col("_w")).orderBy(F.desc("_k"), key).limit(n).drop("_w", "_k")


def numbered_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a number from 0 in the given order, of columns of any type: sorted and numbered in as many
    ranges as Spark's shuffles have partitions."""
    return number_within(df, [], order, name)


def zip_rows(a: DataFrame, order_a: list[Column], b: DataFrame, order_b: list[Column]) -> DataFrame:
    """Rows of a and b side by side by position; rows beyond the shorter table are left out."""
    return numbered_rows(a, order_a, "_at").join(numbered_rows(b, order_b, "_at"), "_at").drop("_at")


def near_equal_parts(df: DataFrame, key: str, parts: int, seed: int) -> DataFrame:
    """df with a random part from 0 to parts - 1; the sizes of parts differ by one at the most."""
    u = draw(F.col(key), seed)
    return numbered_rows(df, [u, F.col(key)], "_at").withColumn("part", (F.col("_at") % parts).cast("int")).drop("_at")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows in a random order, sorted over all executors."""
    return df.orderBy(draw(F.col(key), seed), F.col(key))


def keep_where_any(child: DataFrame, fk: str, condition: Column, keep: Column) -> DataFrame:
    """Rows of groups that have a row with `condition` stay only if they meet `keep`; other groups stay
    whole. A null condition or keep counts as false; rows without a key are one group. The test is one
    aggregation by group, joined back."""
    has = child.groupBy(F.col(fk).alias("_fk")).agg(F.max(F.coalesce(condition, F.lit(False)).cast("int")).alias("_has"))
    return child.join(has, F.col(fk).eqNullSafe(F.col("_fk"))).filter((F.col("_has") == 0) | F.coalesce(keep, F.lit(False))).drop("_has", "_fk")


def random_attr_sets(attrs: list[str], k: int, n: int, seed: int) -> list[tuple[str, ...]]:
    """n sets of k attributes, drawn by the MD5 order of seed, number and name."""
    from hashlib import md5

    rank = lambda i, a: md5(f"{seed}#{i}#{a}".encode()).hexdigest()
    return [tuple(sorted(sorted(attrs, key=lambda a, i=i: rank(i, a))[:k])) for i in range(n)]


def random_order(items: list[tuple[str, ...]], seed: int) -> list[tuple[str, ...]]:
    """The items by the MD5 of seed and names."""
    from hashlib import md5

    return sorted(items, key=lambda s: md5(f"{seed}#{','.join(s)}".encode()).hexdigest())


def mean_kway_tvd(df1: DataFrame, df2: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """One row: the mean, over sets of attributes, of the distance between two tables' shares of cells."""
    def share(df: DataFrame, attrs: tuple[str, ...]) -> DataFrame:
        m = marginal(df, list(attrs))
        return m.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy()))

    each = [tvd(share(df1, s), share(df2, s), list(s)).select("distance") for s in sets]
    return reduce(DataFrame.unionByName, each).agg(F.avg("distance").alias("distance"))
