"""Latent classes by expectation and maximisation over the distinct cells of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.columns import md5_int
from kinweave.operators.marginals import marginal
from kinweave.sources.scratch import saved


def _softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0).cast("double"), lambda s, y: s + y))


def soft_classes(df: DataFrame, attrs: list[str], classes: int, steps: int, seed: int) -> DataFrame:
    """(attrs, v, weights): the table's distinct cells with their counts and, for each class, the probability
    that a row of the cell belongs to it, after so many steps from a random start.

    A maximisation step is one aggregation over exploded class weights. Its result has a row per attribute,
    value and class and comes back by broadcast, as an array over classes for each value; so an expectation
    step adds arrays within a cell's row, and cells are never shuffled. Attributes are independent given the
    class; counts are smoothed by one."""
    key = F.concat_ws("|", *[F.col(a).cast("string") for a in attrs])
    u = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (md5_int(F.concat_ws("#", F.lit(f"{seed}"), k.cast("string"), key)) + F.lit(0.5)) / F.lit(4294967296.0))
    total = F.aggregate(F.col("_u"), F.lit(0.0).cast("double"), lambda s, x: s + x)
    cells = saved(marginal(df, attrs).withColumn("_u", u).withColumn("weights", F.transform("_u", lambda x: x / total)).drop("_u"))
    for _ in range(steps):
        cells = saved(_step(cells, attrs))
    return cells


def _log_shares(attr: str) -> Column:
    """log of the smoothed share of an attribute's value, by class."""
    return F.zip_with(f"_n_{attr}", "_totals", lambda n, s: F.log((n + 1) / (s + F.col(f"_d_{attr}"))))


def _step(cells: DataFrame, attrs: list[str]) -> DataFrame:
    by_class = cells.select("v", F.posexplode("weights").alias("class", "w")).groupBy("class").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    priors = by_class.agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "s"))), lambda x: x["s"]).alias("_totals"))
    out = cells.join(F.broadcast(priors), how="cross")  # one row: an array over classes
    sums = latent_histogram(cells, attrs)
    logits = F.transform("_totals", lambda x: F.log(x))
    for a in attrs:
        mine = sums.filter(F.col("attr") == a).groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "v"))), lambda x: x["v"]).alias(f"_n_{a}"))
        mine = mine.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy())).select(F.col("value").alias(f"_v_{a}"), f"_n_{a}", F.col("_size").alias(f"_d_{a}"))  # a row per value of the attribute
        out = out.join(mine, F.col(a).cast("string").eqNullSafe(F.col(f"_v_{a}")))
        logits = F.zip_with(logits, _log_shares(a), lambda x, y: x + y)
    return out.withColumn("_logits", logits).select(*attrs, "v", _softmax(F.col("_logits")).alias("weights"))


def latent_histogram(cells: DataFrame, attrs: list[str]) -> DataFrame:
    """(attr, value, class, v): counts of each attribute's values by class, each row counted by its weights."""
    values = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])
    rows = cells.select("v", values.alias("values"), F.posexplode("weights").alias("class", "w")).select("class", (F.col("v") * F.col("w")).alias("x"), F.explode("values").alias("c"))
    return rows.groupBy("c.attr", "c.value", "class").agg(F.sum("x").alias("v"))


def hard_classes(cells: DataFrame) -> DataFrame:
    """cells with the likeliest class (the first of equals) in place of the weights."""
    return cells.withColumn("class", (F.array_position("weights", F.array_max("weights")) - 1).cast("int")).drop("weights")
