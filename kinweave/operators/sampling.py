"""Drawing rows: randomised rounding, expansion of counts, and filling a column given others.

Null contexts are contexts of their own everywhere: no row is lost to a null key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from kinweave.functions.columns import md5_int
from kinweave.operators.ordered import number_within
from kinweave.sources.scratch import saved

#: Values that a drawn column may have: they become an array by context.
MOST_VALUES = 50_000
#: Copies of a row that are made at once, and tasks that copies are dealt out to at most.
BLOCK, MOST_TASKS = 1 << 15, 10_000
#: Steps that are looked at one by one.
FEW = 32


def random_round(p: DataFrame, by: list[str], value: str, n: str, key: Column | None = None) -> DataFrame:
    """Integer counts that sum to n by group: floor(share * n), and the rest to the values whose
    fractions are drawn, without replacement, with odds in proportion to them (largest u^(1/f), on
    logarithms). p has (by, value, v, n); a group whose v sum to 0 is dealt out evenly."""
    w = Window.partitionBy(*by)
    total, k = F.sum("v").over(w), F.count(F.lit(1)).over(w)
    share = F.when(total > 0, F.col("v") / total).otherwise(F.lit(1.0) / k)
    q = p.withColumn("_e", F.round(share * F.col(n), 9)).withColumn("_f", F.floor("_e"))
    u = (md5_int(key if key is not None else F.concat_ws("|", *by, value)) + F.lit(0.5)) / F.lit(4294967296.0) if key is not None or by else F.rand()
    frac = F.col("_e") - F.col("_f")
    q = q.withColumn("_left", F.col(n) - F.sum("_f").over(w)).withColumn("_k", F.when(frac > 0, F.log(u) / frac).otherwise(F.lit(-1e300)))
    q = q.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_k"), value)))
    return q.select(*by, value, (F.col("_f") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("n_drawn"))


def expand(counts: DataFrame, n: str) -> DataFrame:
    """Each row n times, with copy from 1. Where a row's copies are more than a block, blocks of them are dealt out
    to tasks first: neither an array nor a task holds all copies of a row."""
    counts = saved(counts.filter(F.col(n) > 0))  # noisy counts are drawn once
    one, upto = F.lit(1).cast("long"), F.col(n).cast("long")
    rows, largest = counts.agg(F.sum(upto), F.max(upto)).first()
    if (largest or 0) <= BLOCK:
        return counts.withColumn("copy", F.explode(F.sequence(one, upto)))
    blocks = counts.withColumn("_from", F.explode(F.sequence(one, upto, F.lit(BLOCK).cast("long"))))
    blocks = blocks.repartition(min(-(-rows // (8 * BLOCK)), MOST_TASKS))
    return blocks.withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + (BLOCK - 1), upto)))).drop("_from")


def join_contexts(rows: DataFrame, contexts: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """rows with the other columns of contexts (one row per context); null keys meet null keys."""
    renamed = contexts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[c for c in contexts.columns if c not in by])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.lit(True))
    return rows.join(renamed, on, how).drop(*[f"_by{i}" for i in range(len(by))])


def _steps(counts: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """(by, _steps): each context's values in order with the sums of their counts up to them. Its length is
    bounded by the attribute's domain, so a row finds its value in it and meets no other row."""
    upto = F.sum(n).over(Window.partitionBy(*by).orderBy(value))
    some = counts.filter(F.col(n) > 0).select(*by, F.struct(upto.alias("upto"), F.col(value).alias("value")).alias("_s"))
    return some.groupBy(*by).agg(F.array_sort(F.collect_list("_s")).alias("_steps"))


def _at(place: Column, most: int | None = None) -> Column:
    """The value of the first step beyond a place. Where there are few steps at most, they are looked at one by one:
    a lambda is interpreted, and what the place is made of is made again for each step."""
    if not 0 < (most or 0) <= FEW:
        return F.get(F.filter("_steps", lambda s: s["upto"] > place), F.lit(0))["value"]
    step = [F.get("_steps", F.lit(i)) for i in range(most)]
    return reduce(lambda found, s: found.when(s["upto"] > place, s["value"]), step[1:], F.when(step[0]["upto"] > place, step[0]["value"]))


def _part(u: Column, total: Column) -> Column:
    """floor(u * total / 2^32) for a u below 2^32 and any total, without a product beyond a long."""
    low, high = F.call_function("mod", F.shiftright(total, 16), F.lit(1 << 16)), F.shiftright(total, 32)
    return u * high + F.shiftright(u * low + F.shiftright(u * total.bitwiseAND(F.lit((1 << 16) - 1)), 16), 16)


def conditional_fill(rows: DataFrame, by: list[str], key: str, weights: DataFrame, value: str) -> DataFrame:
    """rows with a new column: within each combination of `by`, values are dealt out so that their
    counts are the randomised rounding of `weights` (by, value, v). Rows are numbered within their context by
    the key's hash, in ranges, so one context may hold all rows; each looks its number up in the context's
    steps. In a context without weights all values of `weights` are dealt out evenly."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    values = [r[0] for r in weights.select(value).distinct().limit(MOST_VALUES + 1).collect()]
    if len(values) > MOST_VALUES:
        raise ValueError(f"{value} has more than {MOST_VALUES} values")
    weights = weights.select(*by, value, F.col("v").cast("double").alias("v"))
    known = weights.select(*by).distinct().withColumn("_known", F.lit(True))
    sizes = join_contexts(sizes, known, by)
    every = F.array(*map(F.lit, values)).cast(ArrayType(weights.schema[value].dataType))
    bare = sizes.filter("_known is null").select(*by, F.explode(every).alias(value), F.lit(1.0).alias("v"), "_n")
    counts = join_contexts(weights, sizes.drop("_known"), by, "inner").unionByName(bare)
    # written: else each later look at the column would count the rows' contexts again
    steps = saved(_steps(random_round(counts, by, value, "_n"), by, value, "n_drawn"))
    most = steps.agg(F.max(F.size("_steps"))).first()[0]
    # the hash is a column: a sort makes an expression again in every comparison
    numbered = number_within(rows.withColumn("_hash", md5_int(F.col(key))), by, [F.col("_hash"), F.col(key)], "_i").drop("_hash")
    return join_contexts(numbered, steps, by).withColumn(value, _at(F.col("_i"), most)).drop("_i", "_steps")


def inverse_cdf(rows: DataFrame, by: list[str], key: Column, weights: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """rows with a value drawn by its integer weight `n` within `by`, from the key's hash: no order
    over the rows, so a context may hold any share of them. Null in a context without weights. `most`: how many
    values a context has at most, where that is known."""
    steps = _steps(weights, by, value, "n").withColumn("_total", F.element_at("_steps", -1)["upto"])
    # floor(u * total / 2^32), exactly: it is below a step's sum if u * total is below it times 2^32
    drawn = join_contexts(rows, steps, by).withColumn("_u", _part(md5_int(key), F.col("_total")))
    return drawn.withColumn(value, _at(F.col("_u"), most)).drop("_steps", "_total", "_u")


def resample_column(rows: DataFrame, target: str, potentials: list[DataFrame], key: Column) -> DataFrame:
    """rows with `target` drawn anew given the other columns, from the product of several factors given as
    log-potentials (attributes, v). The product is made for the distinct contexts that occur, never over the
    whole domain: each is joined with one factor after the other, shifted by its largest sum and normalised,
    in parts of 1e9. A context that some factor has no cell for keeps its rows' values. Factors without the
    target say nothing of it."""
    potentials = [p for p in potentials if target in p.columns]
    given = sorted({c for p in potentials for c in p.columns} - {"v", target})
    table = rows.select(*given).distinct()
    for k, p in enumerate(potentials):
        on = [c for c in p.columns if c not in ("v", target)] + ([target] if k else [])
        table = join_contexts(table, p.withColumnRenamed("v", "_v"), on, "inner").withColumn("_sum", (F.col("_sum") if k else F.lit(0.0)) + F.col("_v")).drop("_v")
    w = Window.partitionBy(*given)
    table = table.withColumn("_e", F.exp(F.col("_sum") - F.max("_sum").over(w)))
    table = table.withColumn("n", F.floor(F.col("_e") / F.sum("_e").over(w) * 1e9 + 0.5).cast("long"))
    out = inverse_cdf(rows.withColumnRenamed(target, "_old"), given, key, table.select(*given, target, "n"), target)
    return out.withColumn(target, F.coalesce(target, "_old")).select(*rows.columns)
