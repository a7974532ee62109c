"""Hierarchical matching of two relations: a 1:1 pairing that agrees on as many columns as it can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.ordered import number_within
from kinweave.operators.sampling import join_contexts


def match(a: DataFrame, b: DataFrame, columns: list[str], key_a: str, key_b: str) -> DataFrame:
    """(key_a, key_b, agreed): rows of a and b paired one to one.

    Column by column, rows of one bucket and value are numbered on both sides; as many as both sides
    have go on with that value, the others with a star. So both sides end with equally many rows in
    each bucket but for rows beyond the shorter side, and are joined on bucket and number. Two nulls agree.
    Buckets and values are numbered in ranges: one may hold any share of the rows."""
    for c in columns:
        if c not in a.columns or c not in b.columns:
            raise ValueError(f"{c} is missing")
    star = F.struct(F.lit(True).alias("star"), F.lit("").alias("value"))
    start = lambda df: df.withColumn("_bucket", F.array().cast("array<struct<star:boolean,value:string>>")).withColumn("_agreed", F.lit(0))
    a, b = start(a), start(b)
    for c in columns:
        n_a = a.groupBy("_bucket", c).agg(F.count(F.lit(1)).alias("_na"))
        n_b = b.groupBy("_bucket", c).agg(F.count(F.lit(1)).alias("_nb"))
        both = join_contexts(n_a, n_b, ["_bucket", c], "inner").select("_bucket", c, F.least("_na", "_nb").alias("_both"))

        def step(df: DataFrame, key: str, c: str = c, both: DataFrame = both) -> DataFrame:
            j = join_contexts(number_within(df, ["_bucket", c], [F.col(key)], "_r"), both, ["_bucket", c])
            same = F.col("_r") < F.coalesce("_both", F.lit(0))
            tag = F.when(same, F.struct(F.lit(False).alias("star"), F.col(c).cast("string").alias("value"))).otherwise(star)
            return j.withColumn("_bucket", F.concat("_bucket", F.array(tag))).withColumn("_agreed", F.col("_agreed") + same.cast("int")).drop("_r", "_both")

        a, b = step(a, key_a), step(b, key_b)
    number = lambda df, key: number_within(df.select(key, "_bucket", "_agreed"), ["_bucket"], [F.col(key)], "_r")
    out = number(a, key_a).join(number(b, key_b).drop("_agreed"), ["_bucket", "_r"])
    return out.select(key_a, key_b, F.col("_agreed").alias("agreed"))
