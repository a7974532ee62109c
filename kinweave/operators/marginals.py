"""Marginals in long form (attributes, v) and what is computed from them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def marginal(df: DataFrame, attrs: list[str], weight: Column | None = None) -> DataFrame:
    """(attrs, v): counts, or sums of weight, of the combinations that occur."""
    return df.groupBy(*attrs).agg((F.sum(weight) if weight is not None else F.count(F.lit(1)).cast("double")).alias("v"))


def densify(m: DataFrame, values: dict[str, DataFrame], limit: int = 50_000) -> DataFrame:
    """All combinations of the attributes' values, v = 0 where none occurs: noise has to reach every
    cell. The number of cells is checked against `limit` before the product is made."""
    cells = reduce(lambda a, b: a * b, [d.count() for d in values.values()])
    if cells > limit:
        raise ValueError(f"{cells} cells are more than {limit}")
    grid = reduce(lambda a, b: a.join(b, how="cross"), [d.select(a) for a, d in values.items()])
    return grid.join(m, list(values), "left").fillna(0.0, ["v"])


def filled(m: DataFrame, axes: dict[str, list], limit: int = 50_000, absent: float = 0.0) -> DataFrame:
    """The same from given domains: their product is checked and made without a look at data. Cells that m
    lacks get `absent`."""
    if prod(map(len, axes.values())) > limit:
        raise ValueError(f"{prod(map(len, axes.values()))} cells are more than {limit}")
    grid, kind = m.sparkSession.range(1), dict(m.dtypes)
    for a, values in axes.items():
        grid = grid.withColumn(a, F.explode(F.array(*map(F.lit, values)).cast(f"array<{kind[a]}>")))
    grid = grid.drop("id")
    joined = grid.join(m, list(axes), "left") if axes else grid.select(F.lit(1)).join(m, how="left")
    return joined.select(*axes, F.coalesce("v", F.lit(float(absent))).alias("v"))


def project(m: DataFrame, attrs: list[str]) -> DataFrame:
    return m.groupBy(*attrs).agg(F.sum("v").alias("v"))


def many_marginals(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """Several marginals in one pass by GROUPING SETS: (marginal, attrs as text, v). Attributes not
    in a marginal are null."""
    attrs = sorted({a for s in sets for a in s})
    got = df.groupingSets([[F.col(a) for a in s] for s in sets], *[F.col(a) for a in attrs]).agg(F.grouping_id(*attrs).alias("g"), F.count(F.lit(1)).cast("double").alias("v"))
    number = {s: sum(1 << (len(attrs) - 1 - k) for k, a in enumerate(attrs) if a not in s) for s in sets}
    name = reduce(lambda acc, s: F.when(F.col("g") == number[s], ",".join(s)).otherwise(acc), sets, F.lit(None))
    return got.select(name.alias("marginal"), *[F.col(a).cast("string").alias(a) for a in attrs], "v")


def cell_counts(df: DataFrame, sets: list[tuple[str, ...]], weight: Column | None = None) -> DataFrame:
    """Several marginals in one pass and one form: (marginal, cell, v), names joined by commas and values by |,
    in which \\ and | are escaped. A row becomes an array of its cells, which is exploded and counted, partially on the
    map side."""
    text = lambda a: F.regexp_replace(F.coalesce(F.col(a).cast("string"), F.lit("\\0")), r"([\\|])", r"\\$1")
    cells = F.array(*[F.struct(F.lit(",".join(s)).alias("marginal"), F.concat_ws("|", *map(text, s)).alias("cell")) for s in sets])
    w = (weight if weight is not None else F.lit(1.0)).alias("w")
    return df.select(F.explode(cells).alias("c"), w).groupBy("c.marginal", "c.cell").agg(F.sum("w").alias("v"))


def legalise(m: DataFrame, member: int, size: str = "size") -> DataFrame:
    """Cells of groups too small to have this member become 0."""
    return m.withColumn("v", F.when(F.col(size) <= member, 0.0).otherwise(F.col("v")))


def _bin(size: str, low: int) -> Column:
    return F.when(F.col(size) >= low, F.lit(low)).otherwise(F.col(size)).cast("long")


def merge_sizes(m: DataFrame, attrs: list[str], low: int, size: str = "size") -> DataFrame:
    """Sizes from `low` on become one bin."""
    return m.withColumn(size, _bin(size, low)).groupBy(size, *attrs).agg(F.sum("v").alias("v"))


def unmerge_sizes(merged: DataFrame, attrs: list[str], low: int, histogram: DataFrame, size: str = "size") -> DataFrame:
    """The bin's cells dealt out to its sizes in proportion to the histogram (size, n_groups)."""
    h = histogram.withColumn("_bin", _bin(size, low))
    h = h.withColumn("_share", F.col("n_groups") / F.sum("n_groups").over(Window.partitionBy("_bin"))).select(size, "_bin", "_share")
    return merged.withColumnRenamed(size, "_bin").join(h, "_bin").select(size, *attrs, (F.col("v") * F.col("_share")).alias("v"))


def normalise_by_size(m: DataFrame, histogram: DataFrame, size: str = "size") -> DataFrame:
    """Each size's cells scaled to the histogram's count; a size whose cells sum to 0 or less, and
    size 0, get 0."""
    total = F.sum("v").over(Window.partitionBy(size))
    j = m.withColumn("_t", total).join(histogram.select(size, "n_groups"), size, "left")
    v = F.when((F.col("_t") > 0) & (F.col(size) > 0), F.col("v") * F.coalesce("n_groups", F.lit(0)) / F.col("_t")).otherwise(0.0)
    return j.withColumn("v", v).drop("_t", "n_groups")


def scale_along(m: DataFrame, attrs: list[str], totals: DataFrame) -> DataFrame:
    """One step of iterative proportional fitting: cells scaled so that their sums over attrs equal
    `totals` (attrs, v)."""
    j = m.withColumn("_s", F.sum("v").over(Window.partitionBy(*attrs))).join(totals.withColumnRenamed("v", "_t"), attrs)
    return j.withColumn("v", F.when(F.col("_s") > 0, F.col("v") * F.col("_t") / F.col("_s")).otherwise(0.0)).drop("_s", "_t")


def fit_proportionally(m: DataFrame, targets: list[tuple[list[str], DataFrame]], rounds: int) -> DataFrame:
    for _ in range(rounds):
        for attrs, totals in targets:
            m = scale_along(m, attrs, totals)
    return m


def pair_counts(df: DataFrame, attrs: list[str], weight: Column | None = None) -> DataFrame:
    """(a, b, x, y, v) for all pairs of attributes, in one pass: a row becomes an array of its pairs,
    which is exploded and counted, partially on the map side."""
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(attrs, 2)])
    w = weight if weight is not None else F.lit(1.0)
    return df.select(F.explode(cells).alias("c"), w.alias("w")).groupBy("c.a", "c.b", "c.x", "c.y").agg(F.sum("w").alias("v"))


def r_scores(joint: DataFrame) -> DataFrame:
    """(a, b, score) = half the sum over all value pairs of |N(x, y) - N(x) N(y) / N|. Pairs that
    don't occur add N(x) N(y) / N: all of them together are N less what the occurring ones hold."""
    w = Window.partitionBy("a", "b")
    j = joint.withColumns({"nx": F.sum("v").over(Window.partitionBy("a", "b", "x")), "ny": F.sum("v").over(Window.partitionBy("a", "b", "y")), "n": F.sum("v").over(w)})
    free = F.col("nx") * F.col("ny") / F.col("n")
    return j.groupBy("a", "b").agg(((F.sum(F.abs(F.col("v") - free)) + F.max("n") - F.sum(free)) / 2).alias("score"))


def entropy(m: DataFrame) -> DataFrame:
    """Shannon entropy in nats of a marginal (one row)."""
    total = F.sum("v")
    return m.filter("v > 0").agg((F.log(total) - F.sum(F.col("v") * F.log("v")) / total).alias("h"))


def mutual_information(joint: DataFrame) -> DataFrame:
    """(a, b, mi) from pair counts."""
    j = joint.filter("v > 0").withColumns({"nx": F.sum("v").over(Window.partitionBy("a", "b", "x")), "ny": F.sum("v").over(Window.partitionBy("a", "b", "y")), "n": F.sum("v").over(Window.partitionBy("a", "b"))})
    return j.groupBy("a", "b").agg(F.sum(F.col("v") / F.col("n") * F.log(F.col("v") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("mi"))


def tvd(m1: DataFrame, m2: DataFrame, attrs: list[str]) -> DataFrame:
    """One row: distance (half the sum of |x - y|) and ratio (over the sum of x; 1 if that is 0)."""
    a, b = m1.withColumnRenamed("v", "x"), m2.withColumnRenamed("v", "y")
    on = reduce(lambda p, q: p & q, [a[c].eqNullSafe(b[c]) for c in attrs])
    j = a.join(b, on, "full").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    d = F.sum(F.abs(F.col("x") - F.col("y"))) / 2
    return j.agg(d.alias("distance"), F.when(F.sum("x") == 0, 1.0).otherwise(d / F.sum("x")).alias("ratio"))


def attr_tvd(df1: DataFrame, df2: DataFrame, attrs: list[str]) -> DataFrame:
    """(attr, distance) between two tables' shares of each value, all attributes in one pass."""
    def values(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("x")) for a in attrs])
        counted = df.select(F.explode(cells).alias("c")).groupBy("c.attr", "c.x").agg(F.count(F.lit(1)).alias("n"))
        return counted.select("attr", "x", (F.col("n") / F.sum("n").over(Window.partitionBy("attr"))).alias(name))

    a, b = values(df1, "p"), values(df2, "q")
    j = a.join(b, (a["attr"] == b["attr"]) & a["x"].eqNullSafe(b["x"]), "full")
    return j.groupBy(F.coalesce(a["attr"], b["attr"]).alias("attr")).agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"))


def composition(child: DataFrame, fk: str, attr: str) -> DataFrame:
    """(key, n): groups by their multiset of values. A group's multiset is its sorted (value, count)
    list, so its length is bounded by the attribute's domain, not by the group's size. In values, the
    separators x and , are escaped, so different multisets have different keys."""
    value = F.regexp_replace(F.col(attr).cast("string"), r"([\\x,])", r"\\$1")
    counts = child.groupBy(fk, attr).agg(F.count(F.lit(1)).alias("c"))
    key = counts.groupBy(fk).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("x", value, F.col("c").cast("string")))), ",").alias("key"))
    return key.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def one_sided_tvd(c1: DataFrame, c2: DataFrame) -> DataFrame:
    """Sum over keys of max(p1 - p2, 0)."""
    share = lambda c, name: c.select("key", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))
    j = share(c1, "p").join(share(c2, "q"), "key", "left")
    return j.agg(F.sum(F.greatest(F.col("p") - F.coalesce("q", F.lit(0.0)), F.lit(0.0))).alias("distance"))


def inconsistent(m1: DataFrame, m2: DataFrame, shared: list[str], tolerance: float) -> DataFrame:
    """The distance of two marginals' projections on what they share, if it exceeds tolerance."""
    return tvd(project(m1, shared), project(m2, shared), shared).filter(F.col("ratio") > tolerance)
