"""Round trips of the given tables through the other formats, and parts of them by key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinweave.operators import draws
from kinweave.plans.draws import _DRAW
from kinweave.plans.relational import query
from kinweave.sources import tables as T
from kinweave.sources.scratch import shared_folder

_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def _place(spark) -> str:
    return f"{shared_folder(spark)}/trip-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE::VARCHAR AS ordered, o_orderpriority FROM orders")
def csv_roundtrip(spark, d):
    """Orders written as CSV files of bounded rows and read with a schema."""
    path = _place(spark)
    T.write_csv(T.table(spark, d, "orders"), path, 50_000)
    back = T.read_csv(spark, path, _ORDERS)
    return back.withColumn("ordered", F.to_date("o_orderdate").cast("string")).drop("o_orderdate")


@query("SELECT p_partkey, p_name, p_size FROM part")
def tbl_roundtrip(spark, d):
    """Parts as pipe-delimited rows with a separator at the end."""
    path = _place(spark)
    line = F.concat(F.concat_ws("|", "p_partkey", "p_name", "p_size"), F.lit("|"))
    T.table(spark, d, "part").select(line.alias("value")).write.text(path)
    return T.read_tbl(spark, path, "p_partkey long, p_name string, p_size int, rest string", ("rest",))


@query("WITH k AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS l_orderkey FROM orders)) SELECT o_orderkey, o_orderstatus, o_custkey FROM orders JOIN k ON o_custkey = l_orderkey WHERE i < floor(0.3 * n)")
def keyed_share(spark, d):
    """Orders of the three tenths of customers whose keys come first."""
    return T.read_keyed(T.table(spark, d, "orders"), "o_orderkey", "o_custkey", ["o_orderstatus"], 0.3)


@query("SELECT o_orderkey, any_value(o_orderpriority) AS o_orderpriority, count(*) AS size FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def split_joined_table(spark, d):
    """Orders and group sizes out of one table that repeats the order on every lineitem."""
    joined = T.table(spark, d, "lineitem").join(T.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("group_type", F.lit(1))
    parents, children, sizes = T.split_denormalised(joined, "o_orderkey", ["o_orderpriority"], ["l_returnflag"])
    n = children.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("size"))
    return parents.join(sizes.join(n, ["o_orderkey", "size"]), "o_orderkey")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def sql_file(spark, d):
    """A query from a text file, its result saved and read again."""
    path = _place(spark)
    T.register(spark, d)
    text = ["-- orders by priority", "SELECT o_orderpriority, count(*) AS n", "FROM orders -- all of them", "GROUP BY o_orderpriority;"]
    spark.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.text(path)
    return T.run_sql_file(spark, path, _place(spark))


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_DRAW.format(8, 'o_orderkey')}, o_orderkey) - 1 AS place FROM orders")
def shuffled_order(spark, d):
    """Each order's place in a random order of all."""
    return draws.numbered_rows(T.table(spark, d, "orders").select("o_orderkey"), [draws.draw(F.col("o_orderkey"), 8), F.col("o_orderkey")], "place")
