"""Queries over whole-table codes, hierarchies and projected marginals, with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import columns as C
from kinweave.operators import codecs, lattice, privacy
from kinweave.operators.marginals import marginal
from kinweave.plans.model import _GAUSS
from kinweave.plans.relational import _MD5, query, r6
from kinweave.sources.tables import table

_BUCKET = "trunc(least(greatest(o_totalprice, 0), 599999) / 1000)"
_HUNDREDTHS = "floor(least(greatest({}, 0), 0.999) * 100 + 0.005)::INT"
_BALANCE = "trunc((CASE WHEN {0} < -1000 THEN 0 WHEN {0} >= 10000 THEN 9999 ELSE {0} END + 1000) / 100)"


@query(f"SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE -1 END::INT AS status, substr(o_orderpriority, 1, 1)::INT - 1 AS priority, (year(o_orderdate) - 1992)::INT AS year, (month(o_orderdate) - 1)::INT AS month, (day(o_orderdate) - 1)::INT AS day, {_BUCKET}::INT AS price FROM orders")
def encode_orders_table(spark, d):
    return codecs.encode_orders(table(spark, d, "orders"))


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate::DATE::VARCHAR AS ordered, ({_BUCKET} * 1000 + 500)::DOUBLE AS o_totalprice FROM orders")
def decode_orders_table(spark, d):
    back = codecs.decode_orders(codecs.encode_orders(table(spark, d, "orders")))
    return back.withColumn("ordered", F.col("o_orderdate").cast("string")).drop("o_orderdate")


_DAYS = "(datediff('day', o_orderdate::DATE, l_shipdate::DATE) - 1)"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT - 1 AS quantity, {_HUNDREDTHS.format('l_discount')} AS discount, {_HUNDREDTHS.format('l_tax')} AS tax,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE -1 END::INT AS flag, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END::INT AS status,
    floor({_DAYS} / 11)::INT AS ship_q, ((({_DAYS} % 11) + 11) % 11)::INT AS ship_r FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def encode_lineitem_table(spark, d):
    return codecs.encode_lineitem(table(spark, d, "lineitem"), table(spark, d, "orders"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(l_quantity * p_retailprice, 4) AS l_extendedprice, round(l_discount, 2) AS l_discount, round(l_tax, 2) AS l_tax, l_returnflag, l_linestatus, l_shipdate::DATE::VARCHAR AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
def decode_lineitem_table(spark, d):
    orders = table(spark, d, "orders")
    back = codecs.decode_lineitem(codecs.encode_lineitem(table(spark, d, "lineitem"), orders), orders, table(spark, d, "part"))
    return back.withColumn("shipped", F.col("l_shipdate").cast("string")).drop("l_shipdate")


@query(f"SELECT c_custkey, c_nationkey, {_BALANCE.format('c_acctbal')}::INT AS balance, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS segment FROM customer")
def encode_customer_table(spark, d):
    c = table(spark, d, "customer")
    return codecs.encode_customer(c, C.dictionary(c, "c_mktsegment"))


@query(f"SELECT c_custkey, c_nationkey, c_mktsegment, ({_BALANCE.format('c_acctbal')} * 100 - 950)::DOUBLE AS c_acctbal FROM customer")
def decode_customer_table(spark, d):
    c = table(spark, d, "customer")
    segments = C.dictionary(c, "c_mktsegment")
    return codecs.decode_customer(codecs.encode_customer(c, segments), segments)


@query(f"SELECT s_suppkey, s_nationkey, {_BALANCE.format('s_acctbal')}::INT AS balance FROM supplier")
def encode_supplier_table(spark, d):
    return codecs.encode_supplier(table(spark, d, "supplier"))


@query("""WITH t AS (SELECT *, regexp_extract(p_brand, '[0-9]+')::INT - 1 AS b, dense_rank() OVER (ORDER BY p_type) - 1 AS t FROM part)
    SELECT p_partkey, p_size, (b // 5)::INT AS brand_q, (b % 5)::INT AS brand_r, (t // 3)::INT AS type_q, (t % 3)::INT AS type_r, trunc(least(greatest(p_retailprice, 0), 1999) / 20)::INT AS retail FROM t""")
def encode_part_table(spark, d):
    p = table(spark, d, "part")
    return codecs.encode_part(p, C.dictionary(p, "p_type"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE least(floor(value), 30)::INT END AS days, (hour(ts) // 6)::INT AS hour_q, (hour(ts) % 6)::INT AS hour_r FROM events WHERE value IS NULL OR value >= 0")
def basket_codes_roundtrip(spark, d):
    """Days since the last order through tens and ones (none: 4 and 0) and back, and the hour's parts."""
    v = F.least(F.floor("value"), F.lit(39))
    e = table(spark, d, "events").filter("value is null or value >= 0")
    e = e.select("event_id", F.hour("ts").alias("h"), F.coalesce(C.quotient(v, 10), F.lit(4)).alias("q"), F.coalesce(C.remainder(v, 10), F.lit(0)).alias("r"))
    return e.select("event_id", codecs.days_of(F.col("q"), F.col("r")).alias("days"), C.quotient(F.col("h"), 6).alias("hour_q"), C.remainder(F.col("h"), 6).alias("hour_r"))


@query("SELECT p_partkey, p_type, p_brand, (dense_rank() OVER (PARTITION BY p_type ORDER BY p_brand) - 1)::INT AS index FROM part")
def index_within_parent_category(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return p.join(codecs.index_within(p, "p_type", "p_brand").drop("n"), ["p_type", "p_brand"])


@query(f"""WITH q AS (SELECT p_type, p_brand, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) - 1 AS i FROM part GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY p_type ORDER BY p_brand)::HUGEINT AS hi, sum(n) OVER (PARTITION BY p_type)::HUGEINT AS t FROM q),
    t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS k, count(*) OVER () AS kinds FROM (SELECT DISTINCT p_type FROM part)),
    r AS (SELECT o_orderkey, p_type, {_MD5.format("o_orderkey || 'i'")} % 40 AS i FROM orders JOIN t ON k = {_MD5.format('o_orderkey')} % kinds),
    f AS (SELECT r.o_orderkey, r.p_type, q.p_brand FROM r LEFT JOIN q ON r.p_type = q.p_type AND r.i = q.i),
    a AS (SELECT o_orderkey, p_type, p_brand, true AS valid FROM f WHERE p_brand IS NOT NULL
        UNION ALL SELECT f.o_orderkey, f.p_type, c.p_brand, false FROM f JOIN c ON f.p_type = c.p_type AND {_MD5.format("f.o_orderkey || 'a'")}::HUGEINT * t >= (hi - n) * 4294967296 AND {_MD5.format("f.o_orderkey || 'a'")}::HUGEINT * t < hi * 4294967296 WHERE f.p_brand IS NULL),
    p AS (SELECT p_partkey, p_type, p_brand, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) - 1 AS j, count(*) OVER (PARTITION BY p_type, p_brand) AS m FROM part)
    SELECT a.o_orderkey, a.p_type, a.p_brand, p.p_partkey, valid FROM a JOIN p ON a.p_type = p.p_type AND a.p_brand = p.p_brand AND p.j = ({_MD5.format("a.o_orderkey || 'p'")} * m) >> 32""")
def hierarchical_fallback_draw(spark, d):
    parts, o = table(spark, d, "part"), table(spark, d, "orders").select("o_orderkey")
    types = C.dictionary(parts, "p_type")
    key = F.col("o_orderkey").cast("string")
    coded = o.withColumn("code", (C.md5_int(key) % types.count()).cast("int")).withColumn("index", (C.md5_int(F.concat(key, F.lit("i"))) % 40).cast("int"))
    rows = coded.join(types, "code").select("o_orderkey", "p_type", "index")
    return codecs.fill_hierarchy(rows, "o_orderkey", parts, "p_type", "p_brand", "p_partkey")


@query(f"SELECT year, nation, count(*) AS n FROM (SELECT (year(o_orderdate) - 1992)::INT AS year, CASE WHEN {_MD5.format('o_orderkey')} < 1717986918 THEN ((year(o_orderdate) - 1992) % 25)::INT ELSE c_nationkey END AS nation FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2")
def correlation_injection(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    j = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.year("o_orderdate") - 1992).alias("year")).join(c, "o_custkey")
    return codecs.inject(j, "nation", F.col("year") % 25, F.col("o_orderkey"), 0.4).groupBy("year", "nation").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT round(count(*) + 4.0 * max({_GAUSS.format(repr('orders'))}), 6) AS v FROM orders")
def noisy_row_count(spark, d):
    n = table(spark, d, "orders").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return privacy.noisy(n, privacy.sigma(2, 0.25), F.lit("orders")).select(r6("v").alias("v"))


_MEASURED = [("l_returnflag", "l_linestatus", "l_linenumber"), ("l_linenumber", "tens")]
_DOMAIN = {"l_returnflag": 3, "l_linestatus": 2, "l_linenumber": 7, "tens": 6}
_LATTICE = lattice.lattice(_MEASURED, _DOMAIN, 2)


@query(" UNION ALL ".join(f"SELECT '{','.join(s)}' AS attrs, concat_ws('|', {', '.join(s)}) AS cell, count(*)::DOUBLE AS v FROM (SELECT *, floor(l_quantity / 10)::INT AS tens FROM lineitem) GROUP BY ALL" for s in _LATTICE))
def projection_lattice(spark, d):
    """All marginals of one or two attributes that two measured ones hold, each from the smaller."""
    li = table(spark, d, "lineitem").withColumn("tens", C.quotient(F.col("l_quantity"), 10))
    tables = {m: marginal(li, list(m)) for m in _MEASURED}
    each = [lattice.project(tables[m], s).select(F.lit(",".join(s)).alias("attrs"), F.concat_ws("|", *s).alias("cell"), F.col("v").cast("double").alias("v")) for s, m in _LATTICE.items()]
    return reduce(DataFrame.unionByName, each)


# ---- injected dependence -----------------------------------------------------------------------

_USUAL = [["A", "N"], ["A", "N"], ["N", "R"], ["R"], ["R"]]
_KEY = "(l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey)"


@query(f"""WITH j AS (SELECT o_orderpriority AS p, {_USUAL}[substr(o_orderpriority, 1, 1)::INT] AS u, ({_MD5.format(_KEY + " || 'f'")} + 0.5) / 4294967296.0::DOUBLE AS x, {_MD5.format(_KEY + " || 'v'")} AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT p AS o_orderpriority, CASE WHEN x < 0.75 THEN u[v % len(u) + 1] ELSE ['A', 'N', 'R'][v % 3 + 1] END AS l_returnflag, count(*) AS n FROM j GROUP BY 1, 2""")
def inject_flag_by_priority(spark, d):
    """Lineitems whose flag follows their order's priority, counted."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    li = table(spark, d, "lineitem").join(o, "l_orderkey")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = codecs.follow(li, "l_returnflag", codecs.code_of("o_orderpriority", codecs.PRIORITY), _USUAL, codecs.FLAG, key, 0.75)
    return out.groupBy("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code, count(*) OVER () AS k FROM (SELECT DISTINCT p_brand FROM lineitem JOIN part ON p_partkey = l_partkey))
    SELECT p_brand, sum(greatest(floor(l_quantity * (0.2::DOUBLE + code * ((2.0::DOUBLE - 0.2::DOUBLE) / (k - 1)))), 1)) AS quantity, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN b USING (p_brand) GROUP BY 1""")
def inject_quantity_by_brand(spark, d):
    """Lineitems whose quantity is scaled by their part's brand, summed."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    li = codecs.scale_by(table(spark, d, "lineitem").select("l_partkey", "l_quantity").join(p, "l_partkey"), "l_quantity", "p_brand", 0.2, 2.0)
    return li.groupBy("p_brand").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT year(o_orderdate)::INT AS year, coalesce(n, 0) AS size, count(*) AS orders FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE coalesce(n, 0) = year(o_orderdate) - 1994 OR {_MD5.format('o_orderkey')} < {2**30} GROUP BY 1, 2""")
def inject_size_by_year(spark, d):
    """Orders whose number of lineitems is their year's, and a quarter of the others, counted."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    kept, children = codecs.keep_by_size(o, "o_orderkey", li, "l_orderkey", F.year("o_orderdate") - 1994, 0.25)
    sizes = children.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size"))
    j = kept.join(sizes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy(F.year("o_orderdate").alias("year"), F.coalesce("size", F.lit(0)).alias("size")).agg(F.count(F.lit(1)).alias("orders"))
