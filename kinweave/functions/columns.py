"""Column functions: seeded uniforms, buckets, dates, quotient and remainder, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.ordered import number_within


def md5_int(key: Column) -> Column:
    """A 32-bit integer from the MD5 of a key's text: the same on every engine. For tests and
    samples only; it is reproducible, so it is no noise for privacy."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def md5_uniform(key: Column) -> Column:
    return (md5_int(key) + F.lit(0.5)) / F.lit(4294967296.0)


def md5_gauss(key: Column) -> Column:
    """A standard normal from two such uniforms (Box-Muller)."""
    u, v = md5_uniform(F.concat(key.cast("string"), F.lit("a"))), md5_uniform(F.concat(key.cast("string"), F.lit("b")))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def bucket(x: Column, low: float, high: float, width: float) -> Column:
    """trunc(clamp(x, low, high) / width) as int."""
    return (F.least(F.greatest(x, F.lit(low)), F.lit(high)) / F.lit(width)).cast("int")


def discount_code(d: Column) -> Column:
    """Hundredths, with half a ten-thousandth against binary fractions."""
    return F.floor(F.least(F.greatest(d, F.lit(0.0)), F.lit(0.999)) * 100 + 0.005).cast("int")


def retail_code(p: Column) -> Column:
    return bucket(p, 0.0, 1999.0, 20.0)


def balance_code(b: Column) -> Column:
    """A low balance counts as 0, one of 10000 or more as 9999; then shifted by 1000, in hundreds."""
    b = F.when(b < -1000, 0.0).when(b >= 10000, 9999.0).otherwise(b)
    return ((b + 1000) / 100).cast("int")


def quotient(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("int")


def remainder(x: Column, n: int) -> Column:
    """Never negative, like floor division asks."""
    return F.pmod(x.cast("long"), F.lit(n)).cast("int")


def date_codes(d: Column, first_year: int = 1992) -> tuple[Column, Column, Column]:
    return F.year(d) - first_year, F.month(d) - 1, F.dayofmonth(d) - 1


def date_of(year: Column, month: Column, day: Column, first_year: int = 1992) -> Column:
    """The inverse; a day that the month doesn't have becomes the 28th."""
    y, m, d = year + first_year, month + 1, day + 1
    last = F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))
    return F.make_date(y, m, F.when(d > last, 28).otherwise(d).cast("int"))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(column, code): ranks of the sorted distinct values. The window runs over the distinct values
    only; for a column of very many, use `wide_dictionary`."""
    return df.select(column).distinct().select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias("code"))


def wide_dictionary(df: DataFrame, column: str) -> DataFrame:
    """The same for columns with very many values: they are ranked in ranges over all executors."""
    return number_within(df.select(column).distinct(), [], [F.col(column)], "code").withColumn("code", F.col("code").cast("int"))


def encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """df with column replaced by its code: -1 for a value that the dictionary lacks, null for null. Spark
    broadcasts the dictionary only while it is small."""
    found = df.join(codes.filter(F.col(column).isNotNull()), column, "left")
    return found.withColumn("code", F.when(F.col(column).isNotNull(), F.coalesce("code", F.lit(-1)))).drop(column).withColumnRenamed("code", column)


def decode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """The inverse; a code that the dictionary lacks becomes null."""
    return df.withColumnRenamed(column, "code").join(codes, "code", "left").drop("code")
