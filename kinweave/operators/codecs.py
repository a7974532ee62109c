"""Whole tables as discrete codes and back, one select each, and draws that follow a hierarchy.

Every encoder keeps the keys and gives one integer column per attribute or part of one; the decoder
of the same name takes it back. Values outside a list of names get -1, and decode to null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import columns as C
from kinweave.operators.ordered import number_within
from kinweave.operators.sampling import inverse_cdf

#: Fixed values of the public benchmark's columns.
STATUS, FLAG, LINE_STATUS = ["F", "O", "P"], ["A", "N", "R"], ["F", "O"]
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Days per step of the shipping delay, and the width of a bucket of order totals and its end.
DELAY, PRICE_WIDTH, PRICE_END = 11, 1000.0, 599_999.0


def code_of(column: str, names: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(column)).cast("int") - 1, F.lit(-1))


def name_of(code: Column, names: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), code)


def encode_orders(orders: DataFrame) -> DataFrame:
    year, month, day = C.date_codes(F.col("o_orderdate"))
    price = C.bucket(F.col("o_totalprice"), 0.0, PRICE_END, PRICE_WIDTH)
    return orders.select("o_orderkey", "o_custkey", code_of("o_orderstatus", STATUS).alias("status"), code_of("o_orderpriority", PRIORITY).alias("priority"), year.alias("year"), month.alias("month"), day.alias("day"), price.alias("price"))


def decode_orders(codes: DataFrame) -> DataFrame:
    """Totals are the middles of their buckets."""
    return codes.select(
        "o_orderkey", "o_custkey", name_of(F.col("status"), STATUS).alias("o_orderstatus"), name_of(F.col("priority"), PRIORITY).alias("o_orderpriority"),
        C.date_of(F.col("year"), F.col("month"), F.col("day")).alias("o_orderdate"), ((F.col("price") + 0.5) * PRICE_WIDTH).alias("o_totalprice"),
    )


def encode_lineitem(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The shipping date counts from the day after the order, in steps of DELAY days and a remainder."""
    j = lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    days = F.datediff("l_shipdate", "o_orderdate") - 1
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("int") - 1).alias("quantity"), C.discount_code(F.col("l_discount")).alias("discount"), C.discount_code(F.col("l_tax")).alias("tax"),
        code_of("l_returnflag", FLAG).alias("flag"), code_of("l_linestatus", LINE_STATUS).alias("status"), C.quotient(days, DELAY).alias("ship_q"), C.remainder(days, DELAY).alias("ship_r"),
    )


def decode_lineitem(codes: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Prices follow from quantity and the part's retail price, dates from the order's."""
    j = codes.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    quantity = (F.col("quantity") + 1).cast("double")
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity.alias("l_quantity"), F.round(quantity * F.col("p_retailprice"), 4).alias("l_extendedprice"), (F.col("discount") / 100).alias("l_discount"), (F.col("tax") / 100).alias("l_tax"),
        name_of(F.col("flag"), FLAG).alias("l_returnflag"), name_of(F.col("status"), LINE_STATUS).alias("l_linestatus"), F.date_add(F.to_date("o_orderdate"), F.col("ship_q") * DELAY + F.col("ship_r") + 1).alias("l_shipdate"),
    )


def encode_customer(customer: DataFrame, segments: DataFrame) -> DataFrame:
    """`segments` is the dictionary of c_mktsegment (functions.columns.dictionary)."""
    return C.encode(customer, "c_mktsegment", segments).select("c_custkey", "c_nationkey", C.balance_code(F.col("c_acctbal")).alias("balance"), F.col("c_mktsegment").alias("segment"))


def decode_customer(codes: DataFrame, segments: DataFrame) -> DataFrame:
    """Balances are the middles of their hundreds."""
    j = C.decode(codes.withColumnRenamed("segment", "c_mktsegment"), "c_mktsegment", segments)
    return j.select("c_custkey", "c_nationkey", "c_mktsegment", (F.col("balance") * 100.0 - 950.0).alias("c_acctbal"))


def encode_supplier(supplier: DataFrame) -> DataFrame:
    return supplier.select("s_suppkey", "s_nationkey", C.balance_code(F.col("s_acctbal")).alias("balance"))


def encode_part(part: DataFrame, types: DataFrame, type_width: int = 3, brand_width: int = 5) -> DataFrame:
    """Brand and type are split into quotient and remainder, so that no attribute has many values."""
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") - 1
    j = C.encode(part, "p_type", types)
    return j.select(
        "p_partkey", "p_size", C.quotient(brand, brand_width).alias("brand_q"), C.remainder(brand, brand_width).alias("brand_r"),
        C.quotient(F.col("p_type"), type_width).alias("type_q"), C.remainder(F.col("p_type"), type_width).alias("type_r"), C.retail_code(F.col("p_retailprice")).alias("retail"),
    )


# ---- hierarchies -------------------------------------------------------------------------------


def index_within(df: DataFrame, upper: str, lower: str) -> DataFrame:
    """(upper, lower, index, n): the lower names' ranks within their upper one from 0, and rows of each.
    The window runs over distinct pairs."""
    pairs = df.groupBy(upper, lower).agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("index", (F.row_number().over(Window.partitionBy(upper).orderBy(lower)) - 1).cast("int"))


def days_of(q: Column, r: Column) -> Column:
    """Days since the last order from tens and ones: 40 or more stand for none, 31 to 39 for 30."""
    x = q * 10 + r
    return F.when(x >= 40, F.lit(None)).when(x > 30, 30).otherwise(x).cast("int")


def fill_hierarchy(rows: DataFrame, key: str, items: DataFrame, upper: str, lower: str, item: str) -> DataFrame:
    """rows (key, upper, index) with a lower name and an item: the lower name has the given index within
    the upper one; an index that it doesn't have is replaced by a draw of lower names in proportion to their
    items. Items are drawn evenly within (upper, lower). Draws come from the key's hash. A row whose upper name
    is null or has no items stays, with nulls and valid false."""
    items = items.filter(F.col(upper).isNotNull() & F.col(lower).isNotNull())
    pairs = index_within(items, upper, lower)
    found = rows.join(pairs.drop("n"), [upper, "index"], "left").withColumn("valid", F.col(lower).isNotNull())
    bad = inverse_cdf(found.filter(~F.col("valid")).drop(lower), [upper], F.concat(F.col(key).cast("string"), F.lit("a")), pairs.select(upper, lower, "n"), lower)
    both = found.filter("valid").select(key, upper, lower, "valid").unionByName(bad.select(key, upper, lower, "valid"))
    # evenly drawn items are found by their number within the pair: an equality join, no ranges
    numbered = number_within(items.select(upper, lower, item), [upper, lower], [F.col(item)], "_i")
    sizes = pairs.select(upper, lower, "n")
    u = C.md5_int(F.concat(F.col(key).cast("string"), F.lit("p")))
    return both.join(sizes, [upper, lower], "left").withColumn("_i", F.shiftright(u * F.col("n"), 32)).join(numbered, [upper, lower, "_i"], "left").select(key, upper, lower, item, "valid")


def follow(df: DataFrame, column: str, code: Column, usual: list[list[str]], others: list[str], key: Column, share: float) -> DataFrame:
    """df whose column follows another's code: with probability `share` one of usual[code], evenly, else one
    of `others`. A code without a list keeps the row's value."""
    u, pick = C.md5_uniform(F.concat(key, F.lit("f"))), C.md5_int(F.concat(key, F.lit("v")))
    mine = F.get(F.array(*[F.array(*map(F.lit, x)) for x in usual]), code)
    at = lambda xs: F.get(xs, (pick % F.size(xs)).cast("int"))
    value = F.when(u < share, at(mine)).otherwise(at(F.array(*map(F.lit, others))))
    return df.withColumn(column, F.when(mine.isNull(), F.col(column)).otherwise(value))


def scale_by(df: DataFrame, column: str, attr: str, low: float, high: float, least: int = 1) -> DataFrame:
    """df whose numbers are scaled by a ratio that rises evenly from low to high over the sorted values of an
    attribute, rounded down, at least `least`. Rows without the attribute keep their numbers."""
    ranks = C.dictionary(df.filter(F.col(attr).isNotNull()), attr)
    n = ranks.count()
    ratio = F.lit(low) + F.col("code") * F.lit((high - low) / max(1, n - 1))
    scaled = F.greatest(F.floor(F.col(column) * ratio), F.lit(least)).cast(df.schema[column].dataType)
    return df.join(ranks, attr, "left").withColumn(column, F.coalesce(scaled, F.col(column))).select(*df.columns)


def keep_by_size(parent: DataFrame, pk: str, child: DataFrame, fk: str, wanted: Column, share: float) -> tuple[DataFrame, DataFrame]:
    """Parents whose number of children is the wanted one, with a random share of the others, and their
    children: sizes depend on the parent's attributes then. A null wanted number is never met."""
    sizes = child.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
    met = F.coalesce(F.col("_n") == wanted, F.lit(False))
    kept = parent.join(sizes, F.col(pk) == F.col("_fk"), "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(met | (C.md5_int(F.col(pk)) < int(share * 2**32))).select(*parent.columns)
    return kept, child.join(kept.select(F.col(pk).alias(fk)), fk, "left_semi")


def inject(df: DataFrame, column: str, value: Column, key: Column, share: float) -> DataFrame:
    """df whose column is replaced by `value` in a random share of the rows: a known dependence for
    tests of synthesis. Drawn from the key's hash."""
    return df.withColumn(column, F.when(C.md5_int(key) < int(share * 2**32), value).otherwise(F.col(column)))
