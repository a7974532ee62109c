"""Parents and their groups of children: sizes, integrity, samples, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.columns import md5_int
from kinweave.operators.ordered import number_within, sums_before
from kinweave.operators.sampling import expand, random_round
from kinweave.sources.scratch import saved


def sizes(child: DataFrame, fk: str, cap: int | None = None) -> DataFrame:
    """(fk, size), with `cap` no more than that."""
    n = F.count(F.lit(1))
    return child.groupBy(fk).agg((F.least(n, F.lit(cap)) if cap else n).cast("long").alias("size"))


def size_histogram(child: DataFrame, fk: str, cap: int | None = None) -> DataFrame:
    return sizes(child, fk, cap).groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def size_quantiles(child: DataFrame, fk: str, qs: tuple[float, ...]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row each."""
    got = sizes(child, fk).agg(F.percentile("size", F.array(*map(F.lit, qs))).alias("v"))
    return got.select(F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("v"))).alias("x")).select(F.col("x.q").alias("q"), F.col("x.v").alias("v"))


def mass_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The smallest size up to which groups hold at least the share q of all children. The window
    runs over the histogram, one row per size."""
    mass = F.col("size") * F.col("n_groups")
    run = histogram.withColumn("upto", F.sum(mass).over(Window.orderBy("size"))).withColumn("goal", F.lit(q) * F.sum(mass).over(Window.partitionBy()))
    return run.filter("upto >= goal").agg(F.min("size").alias("size"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    return child.join(parent, child[fk] == parent[pk], "left_anti")


def with_children(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    return parent.join(child, parent[pk] == child[fk], "left_semi")


def childless(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    return parent.join(child, parent[pk] == child[fk], "left_anti")


def all_sizes(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """(pk, size) for every parent, 0 for those without children."""
    return parent.select(pk).join(sizes(child, fk), F.col(pk) == F.col(fk), "left").select(pk, F.coalesce("size", F.lit(0)).alias("size"))


def check_keys(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> None:
    if orphans(child, fk, parent, pk).limit(1).count():
        raise ValueError(f"{fk} has values that {pk} lacks")
    if parent.groupBy(pk).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{pk} is not unique")


def check_dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Values of `determinant` with two values of `dependent` or more: none if it determines it."""
    return df.groupBy(determinant).agg(F.count_distinct(dependent).alias("n")).filter("n > 1")


def domain(df: DataFrame, attrs: list[str]) -> DataFrame:
    """(attr, low, high, size) in one pass; size is high + 1."""
    got = df.agg(*[f(a).cast("long").alias(f"{n}_{a}") for a in attrs for n, f in (("l", F.min), ("h", F.max))])
    stacked = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"l_{a}").alias("low"), F.col(f"h_{a}").alias("high"), (F.col(f"h_{a}") + 1).alias("size")) for a in attrs])
    return got.select(F.explode(stacked).alias("x")).select("x.*")


def check_domain(df: DataFrame, sizes_by_attr: dict[str, int]) -> None:
    bad = [r.attr for r in domain(df, list(sizes_by_attr)).collect() if r.low is not None and (r.low < 0 or r.high >= sizes_by_attr[r.attr])]
    if bad:
        raise ValueError(f"values outside the domain: {bad}")


def at_most(child: DataFrame, fk: str, n: int, order: list[Column]) -> DataFrame:
    """Up to n rows of each group, in the given order."""
    return child.withColumn("_rn", F.row_number().over(Window.partitionBy(fk).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def drop_large(child: DataFrame, fk: str, cap: int) -> DataFrame:
    """Children of groups of at most cap."""
    return child.join(sizes(child, fk).filter(F.col("size") <= cap).select(fk), fk, "left_semi")


def cascade_sample(parent: DataFrame, pk: str, child: DataFrame, fk: str, share: float) -> tuple[DataFrame, DataFrame]:
    """A share of the parents, by key, and their children."""
    kept = parent.filter(md5_int(F.col(pk)) < F.lit(int(share * 2**32)))
    return kept, child.join(kept.select(F.col(pk).alias(fk)), fk, "left_semi")


def round_robin(rows: DataFrame, key: str, order: list[Column], targets: DataFrame, target: str) -> DataFrame:
    """Each row gets one of its key's targets in turn: the i-th row the (i mod n)-th target."""
    r = rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    t = targets.select(key, target).withColumn("_j", F.row_number().over(Window.partitionBy(key).orderBy(target)) - 1)
    n = targets.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return r.join(n, key).withColumn("_j", F.pmod("_i", "_n")).join(t, [key, "_j"]).drop("_i", "_j", "_n")


def index_in_parent(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent, child, index): ranks of the distinct children within their parent."""
    return df.select(parent, child).distinct().withColumn("index", F.row_number().over(Window.partitionBy(parent).orderBy(child)) - 1)


def ratio_to_total(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, p): the share of each value within its key. Counted first, then compared."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def flatten(child: DataFrame, fk: str, attrs: list[str], slots: int, order: list[Column]) -> DataFrame:
    """One row per group: size, and m{t}_{attr} for the first slots (null where there are fewer)."""
    c = child.withColumn("_t", F.row_number().over(Window.partitionBy(fk).orderBy(*order)) - 1)
    pick = [F.max(F.when(F.col("_t") == t, F.col(a))).alias(f"m{t}_{a}") for t in range(slots) for a in attrs]
    return c.groupBy(fk).agg(F.count(F.lit(1)).alias("size"), *pick)


def recover(flat: DataFrame, fk: str, attrs: list[str], slots: int) -> DataFrame:
    """Children again from a flat row: (fk, slot, attrs) for the slots below size."""
    cells = F.array(*[F.struct(F.lit(t).alias("slot"), *[F.col(f"m{t}_{a}").alias(a) for a in attrs]) for t in range(slots)])
    return flat.select(fk, F.explode(F.slice(cells, 1, F.least("size", F.lit(slots)).cast("int"))).alias("x")).select(fk, "x.*")


def group_ids(rows: DataFrame, key: str, histogram: DataFrame, seed: int) -> DataFrame:
    """rows with a random `group` number, so that the groups' sizes follow a histogram (size, n): as many
    groups as the rows fill, their number of each size the randomised rounding of its share, exact where the
    histogram fits. Groups lie side by side in a random order, each covers its places, the last one is
    clipped; rows in a random order take the places. Sizes of 0 make no group."""
    histogram = histogram.filter("size > 0 and n > 0")
    n_rows = rows.count()
    mass, members = histogram.agg(F.sum("n"), F.sum(F.col("size") * F.col("n"))).first()
    if n_rows and not members:
        raise ValueError("the histogram has no members")
    n_groups, covered, counts = -(-n_rows * (mass or 0) // (members or 1)), -1, None
    while covered < n_rows:
        p = histogram.select("size", F.col("n").cast("double").alias("v"), F.lit(n_groups).alias("_n"))
        counts = saved(random_round(p, [], "size", "_n", F.concat_ws("|", F.lit(f"{seed}#{n_groups}"), "size")))
        covered = counts.agg(F.sum(F.col("size") * F.col("n_drawn"))).first()[0] or 0
        n_groups += max(1, -(-(n_rows - covered) * (mass or 1) // (members or 1)))
        if not n_rows:
            break
    order = [md5_int(F.concat_ws("-", F.lit(f"{seed}"), "size", "copy")), F.col("size"), F.col("copy")]
    placed = sums_before(expand(counts, "n_drawn"), [], order, {"group": F.lit(1).cast("long"), "_start": F.col("size")})
    places = placed.filter(F.col("_start") < n_rows).select("group", F.explode(F.sequence("_start", F.least(F.col("_start") + F.col("size"), F.lit(n_rows)) - 1)).alias("_at"))
    return number_within(rows, [], [md5_int(F.concat_ws("#", F.lit(f"{seed}"), F.col(key).cast("string"))), F.col(key)], "_at").join(places, "_at").drop("_at")


def multiset_contains(whole: DataFrame, part: DataFrame, key: str, item: str) -> DataFrame:
    """(key, contained) for the keys of `part`: whether the key's items in `whole` hold each of its items in
    `part` at least as often. Null items are items; a null key is a key."""
    counts = lambda df, name: df.groupBy(F.col(key).alias(f"_k_{name}"), F.col(item).alias(f"_i_{name}")).agg(F.count(F.lit(1)).alias(name))
    a, b = counts(whole, "have"), counts(part, "need")
    j = b.join(a, F.col("_k_need").eqNullSafe(F.col("_k_have")) & F.col("_i_need").eqNullSafe(F.col("_i_have")), "left")
    return j.groupBy(F.col("_k_need").alias(key)).agg((F.min(F.coalesce("have", F.lit(0)) - F.col("need")) >= 0).alias("contained"))


def map_per_key(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, entries): a map from the key's names to their values, entries in the order of names; of a name's
    values the smallest counts. Rows without a name have no entry."""
    one = df.filter(F.col(name).isNotNull()).groupBy(key, name).agg(F.min(value).alias("_value"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col("_value").alias("value"))))
    return one.groupBy(key).agg(F.map_from_entries(pairs).alias("entries"))


def same_map(a: Column, b: Column) -> Column:
    """Whether two maps have the same entries, in any order."""
    return F.array_sort(F.map_entries(a)).eqNullSafe(F.array_sort(F.map_entries(b)))
