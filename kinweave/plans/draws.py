"""Queries over seeded draws, row numbers and conditional keeps, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import draws
from kinweave.plans.relational import query, r6
from kinweave.sources.tables import table

_DRAW = "CAST('0x' || substr(md5('{0}#' || CAST({1} AS VARCHAR)), 1, 8) AS BIGINT)"


@query(f"SELECT c_custkey, c_nationkey FROM customer ORDER BY {_DRAW.format(5, 'c_custkey')}, c_custkey LIMIT 100")
def fixed_random_parents(spark, d):
    return draws.fixed_subset(table(spark, d, "customer"), "c_custkey", 100, 5).select("c_custkey", "c_nationkey")


@query(f"SELECT o_orderkey FROM orders WHERE o_totalprice > 0 ORDER BY ln(({_DRAW.format(9, 'o_orderkey')} + 0.5) / 4294967296.0) / o_totalprice DESC, o_orderkey LIMIT 50")
def weighted_random_orders(spark, d):
    return draws.weighted_subset(table(spark, d, "orders"), "o_orderkey", F.col("o_totalprice"), 50, 9).select("o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def surrogate_row_id(spark, d):
    return draws.numbered_rows(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], "row_id")


@query("SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS i FROM supplier) b USING (i)")
def positional_zip(spark, d):
    a, b = table(spark, d, "customer").select("c_custkey"), table(spark, d, "supplier").select("s_suppkey")
    return draws.zip_rows(a, [F.col("c_custkey")], b, [-F.col("s_suppkey")])


@query(f"SELECT o_orderkey, ((row_number() OVER (ORDER BY {_DRAW.format(2, 'o_orderkey')}, o_orderkey) - 1) % 7)::INT AS part FROM orders")
def near_equal_split(spark, d):
    return draws.near_equal_parts(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7, 2)


@query("WITH h AS (SELECT l_orderkey, max((l_returnflag = 'R')::INT) AS has FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem JOIN h USING (l_orderkey) WHERE has = 0 OR l_quantity > 20")
def group_conditional_keep(spark, d):
    return draws.keep_where_any(table(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_quantity") > 20).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


_ATTRS = ["l_returnflag", "l_linestatus", "l_discount", "l_tax"]
_SETS = draws.random_attr_sets(_ATTRS, 2, 3, 4)


def _tvd_sql(attrs: tuple[str, ...]) -> str:
    cells = ", ".join(attrs)
    part = f"(SELECT {cells}, count(*)::DOUBLE / sum(count(*)) OVER () AS {{}} FROM lineitem WHERE l_orderkey % 2 = {{}} GROUP BY {cells})"
    return f"SELECT sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2 AS d FROM {part.format('p', 0)} a FULL JOIN {part.format('q', 1)} b USING ({cells})"


@query(f"SELECT round(avg(d), 6) AS distance FROM ({' UNION ALL '.join(map(_tvd_sql, _SETS))})")
def mean_kway_marginal_tvd(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", *_ATTRS)
    return draws.mean_kway_tvd(li.filter("l_orderkey % 2 = 0"), li.filter("l_orderkey % 2 = 1"), _SETS).select(r6("distance").alias("distance"))
