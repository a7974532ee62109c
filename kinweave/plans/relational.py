"""Queries over the relational tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import columns as C
from kinweave.operators import groups as G
from kinweave.operators import marginals as M
from kinweave.operators import permute as P
from kinweave.sources.tables import row_counts, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE = ", ".join(LINE)
_MD5 = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8) AS BIGINT)"
#: Group cap of lineitem within orders.
CAP = 7
_MEMBERS = f"""m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS rn FROM lineitem),
    c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM m WHERE rn <= {CAP})"""
_SIZES = "s AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def members(spark: SparkSession, d: str, cap: int = CAP) -> DataFrame:
    return P.numbered(table(spark, d, "lineitem"), "l_orderkey", [F.col(c) for c in LINE], cap)


# ---- sources -----------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")))
def table_row_counts(spark, d):
    return row_counts(spark, d)


# ---- groups and keys ---------------------------------------------------------------------------


@query(f"WITH {_SIZES} SELECT least(size, {CAP}) AS size, count(*) AS n_groups FROM s GROUP BY 1")
def group_size_hist(spark, d):
    return G.size_histogram(table(spark, d, "lineitem"), "l_orderkey", CAP)


@query(f"WITH {_SIZES}, q AS (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99])::DOUBLE AS q) SELECT q, round((SELECT quantile_cont(size, [0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99]) FROM s)[list_position([0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99]::DOUBLE[], q)], 6) AS v FROM q")
def group_size_quantiles(spark, d):
    return G.size_quantiles(table(spark, d, "lineitem"), "l_orderkey", (0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.99)).select("q", r6("v").alias("v"))


@query(f"WITH {_SIZES}, h AS (SELECT size, count(*) AS k FROM s GROUP BY 1), r AS (SELECT size, sum(size * k) OVER (ORDER BY size) AS upto, sum(size * k) OVER () AS total FROM h) SELECT min(size) AS size FROM r WHERE upto >= 0.9 * total")
def size_mass_quantile(spark, d):
    return G.mass_quantile(G.size_histogram(table(spark, d, "lineitem"), "l_orderkey"), 0.9)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def orphans_anti(spark, d):
    return G.orphans(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"), "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)")
def parents_with_children(spark, d):
    return G.with_children(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)")
def childless_parents(spark, d):
    return G.childless(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey").select("o_orderkey")


@query(f"WITH {_SIZES} SELECT o_orderkey, coalesce(size, 0) AS size FROM orders LEFT JOIN s ON l_orderkey = o_orderkey")
def childless_left(spark, d):
    return G.all_sizes(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT 'l_linenumber' AS attr, min(l_linenumber)::BIGINT AS low, max(l_linenumber)::BIGINT AS high, max(l_linenumber)::BIGINT + 1 AS size FROM lineitem UNION ALL SELECT 'l_quantity', min(l_quantity)::BIGINT, max(l_quantity)::BIGINT, max(l_quantity)::BIGINT + 1 FROM lineitem")
def domain_minmax(spark, d):
    return G.domain(table(spark, d, "lineitem"), ["l_linenumber", "l_quantity"])


@query("SELECT n_regionkey, count(DISTINCT n_name) AS n FROM nation GROUP BY 1 HAVING count(DISTINCT n_name) > 1")
def dependency_check(spark, d):
    return G.check_dependency(table(spark, d, "nation"), "n_regionkey", "n_name")


@query(f"WITH m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {_MD5.format('o_orderkey')}, o_orderkey) AS rn FROM orders) SELECT o_orderkey, o_custkey FROM m WHERE rn <= 10")
def downsample_topn(spark, d):
    return G.at_most(table(spark, d, "orders"), "o_custkey", 10, [C.md5_int(F.col("o_orderkey")), F.col("o_orderkey")]).select("o_orderkey", "o_custkey")


@query("WITH k AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) <= 10) SELECT o_orderkey, o_custkey FROM orders SEMI JOIN k USING (o_custkey)")
def drop_large_groups(spark, d):
    return G.drop_large(table(spark, d, "orders"), "o_custkey", 10).select("o_orderkey", "o_custkey")


@query(f"WITH k AS (SELECT o_orderkey FROM orders WHERE {_MD5.format('o_orderkey')} < {int(0.3 * 2**32)}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM k)")
def cascade_sample(spark, d):
    return G.cascade_sample(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", 0.3)[1].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH r AS (SELECT s_suppkey, s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier),
    t AS (SELECT c_custkey, c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS j, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT s_suppkey, c_custkey, r.k AS nation FROM r JOIN t ON r.k = t.k AND r.i % t.n = t.j""")
def round_robin_assign(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return G.round_robin(rows, "nation", [F.col("s_suppkey")], table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), "c_custkey").select("s_suppkey", "c_custkey", "nation")


@query('SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS "index" FROM nation')
def index_in_parent(spark, d):
    return G.index_in_parent(table(spark, d, "nation"), "n_regionkey", "n_nationkey")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey), 6) AS p FROM customer GROUP BY 1, 2")
def ratio_to_total(spark, d):
    return G.ratio_to_total(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment").withColumn("p", r6("p"))


_FLAT = ", ".join(f"max(CASE WHEN rn = {t + 1} THEN {a} END) AS m{t}_{a}" for t in range(CAP) for a in ("l_returnflag", "l_linestatus"))


@query(f"WITH {_MEMBERS} SELECT l_orderkey, count(*) AS size, {_FLAT} FROM c GROUP BY l_orderkey")
def flatten_pivot(spark, d):
    return G.flatten(members(spark, d).drop("rn", "n"), "l_orderkey", ["l_returnflag", "l_linestatus"], CAP, [F.col(c) for c in LINE])


@query(f"WITH {_MEMBERS} SELECT l_orderkey, (rn - 1)::INT AS slot, l_returnflag, l_linestatus FROM c")
def recover_explode(spark, d):
    flat = flatten_pivot(spark, d)
    return G.recover(flat, "l_orderkey", ["l_returnflag", "l_linestatus"], CAP)


# ---- encoding ----------------------------------------------------------------------------------


@query("SELECT DISTINCT o_orderpriority, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM orders")
def dict_encode(spark, d):
    return C.dictionary(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT DISTINCT c_name, (dense_rank() OVER (ORDER BY c_name) - 1)::INT AS code FROM customer")
def dict_encode_wide(spark, d):
    return C.wide_dictionary(table(spark, d, "customer"), "c_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def dict_roundtrip(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    codes = C.dictionary(o, "o_orderpriority")
    return C.decode(C.encode(o, "o_orderpriority", codes), "o_orderpriority", codes).select("o_orderkey", "o_orderpriority")


@query("""SELECT p_partkey, trunc(least(greatest(p_retailprice, 0), 1999) / 20)::INT AS price_code FROM part""")
def bucket_numeric(spark, d):
    return table(spark, d, "part").select("p_partkey", C.retail_code(F.col("p_retailprice")).alias("price_code"))


@query("SELECT c_custkey, trunc(((CASE WHEN c_acctbal < -1000 THEN 0 WHEN c_acctbal >= 10000 THEN 9999 ELSE c_acctbal END) + 1000) / 100)::INT AS balance_code FROM customer")
def bucket_balance(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.balance_code(F.col("c_acctbal")).alias("balance_code"))


@query("SELECT floor(least(greatest(l_discount, 0), 0.999) * 100 + 0.005)::INT AS discount_code, count(*) AS n FROM lineitem GROUP BY 1")
def bucket_discount(spark, d):
    return table(spark, d, "lineitem").groupBy(C.discount_code(F.col("l_discount")).alias("discount_code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, (year(o_orderdate) - 1992)::INT AS y, (month(o_orderdate) - 1)::INT AS m, (day(o_orderdate) - 1)::INT AS dd, o_orderdate::DATE::VARCHAR AS back FROM orders")
def date_triple(spark, d):
    y, m, dd = C.date_codes(F.col("o_orderdate"))
    o = table(spark, d, "orders").select("o_orderkey", y.alias("y"), m.alias("m"), dd.alias("dd"))
    return o.withColumn("back", C.date_of(F.col("y"), F.col("m"), F.col("dd")).cast("string"))


@query(f"SELECT l_orderkey, {_LINE.replace('l_shipdate', 'l_shipdate AS shipped')}, floor(days / 11)::INT AS q, (((days % 11) + 11) % 11)::INT AS r, (o_orderdate::DATE + (days + 1)::INT)::DATE::VARCHAR AS back FROM (SELECT l.*, o.o_orderdate, datediff('day', o.o_orderdate::DATE, l.l_shipdate::DATE) - 1 AS days FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)")
def date_offset_divmod(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.withColumn("days", F.datediff("l_shipdate", "o_orderdate") - 1)
    q, r = C.quotient(F.col("days"), 11), C.remainder(F.col("days"), 11)
    return j.select("l_orderkey", *LINE[:-1], F.col("l_shipdate").alias("shipped"), q.alias("q"), r.alias("r"), F.date_add(F.to_date("o_orderdate"), q * 11 + r + 1).cast("string").alias("back"))


@query("SELECT p_partkey, p_size, floor(p_size / 7)::INT AS q, (p_size % 7)::INT AS r, (floor(p_size / 7) * 7 + p_size % 7)::INT AS back FROM part")
def factorize_roundtrip(spark, d):
    q, r = C.quotient(F.col("p_size"), 7), C.remainder(F.col("p_size"), 7)
    return table(spark, d, "part").select("p_partkey", "p_size", q.alias("q"), r.alias("r"), (q * 7 + r).alias("back"))


@query("SELECT floor(x / 10)::INT AS q1, (x::BIGINT % 10)::INT AS q2, count(*) AS n FROM (SELECT l_quantity * (1 + p_size % 3) AS x FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2")
def qty_ratio_encode(spark, d):
    ratio = table(spark, d, "part").select("p_partkey", (1 + F.col("p_size") % 3).alias("ratio"))
    x = table(spark, d, "lineitem").join(ratio, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_quantity") * F.col("ratio")).alias("x"))
    return x.groupBy(C.quotient(F.col("x"), 10).alias("q1"), C.remainder(F.col("x"), 10).alias("q2")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS was, round(l_quantity * p_retailprice, 4) AS price FROM lineitem JOIN part ON l_partkey = p_partkey")
def price_derivation(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    j = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("was"), F.round(F.col("l_quantity") * F.col("p_retailprice"), 4).alias("price"))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 4 ELSE floor(least(floor(value), 30) / 10)::INT END AS part1, CASE WHEN value IS NULL THEN 0 ELSE (least(floor(value), 30)::BIGINT % 10)::INT END AS part2 FROM events WHERE value IS NULL OR value >= 0""")
def null_code_encode(spark, d):
    v = F.least(F.floor("value"), F.lit(30))
    e = table(spark, d, "events").filter("value is null or value >= 0")
    return e.select("event_id", F.coalesce(C.quotient(v, 10), F.lit(4)).alias("part1"), F.coalesce(C.remainder(v, 10), F.lit(0)).alias("part2"))


# ---- pairs and permutations --------------------------------------------------------------------


@query(f"WITH {_MEMBERS} SELECT a.l_orderkey, a.rn::INT AS rn_a, b.rn::INT AS rn_b, a.l_returnflag AS a_l_returnflag, b.l_returnflag AS b_l_returnflag FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.rn < b.rn")
def pairs_unordered(spark, d):
    return P.pairs(members(spark, d), "l_orderkey", ["l_returnflag"])


@query(f"""WITH {_MEMBERS}, p AS (SELECT a.l_orderkey, a.rn AS rn_a, b.rn AS rn_b, a.n, row_number() OVER (PARTITION BY a.l_orderkey ORDER BY {_MD5.format("concat_ws('-', a.l_orderkey, a.rn, b.rn)")}, a.rn, b.rn) AS r
    FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.rn < b.rn)
    SELECT l_orderkey, rn_a::INT AS rn_a, rn_b::INT AS rn_b, round(n / least(5, n * (n - 1) / 2), 6) AS weight FROM p WHERE r <= 5""")
def pairs_capped(spark, d):
    return P.ranked_pairs(members(spark, d), "l_orderkey", [], 5).select("l_orderkey", "rn_a", "rn_b", r6("weight").alias("weight"))


_PERM2 = """p AS (SELECT a.l_orderkey, a.n, a.l_returnflag AS m0_l_returnflag, b.l_returnflag AS m1_l_returnflag, 1.0::DOUBLE / (a.n * greatest(a.n - 1, 1)) AS w
    FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND (a.rn <> b.rn OR a.n = 1))"""


@query(f"WITH {_MEMBERS} SELECT o_orderpriority, n, l_returnflag AS m0_l_returnflag, l_linestatus AS m0_l_linestatus, round(sum(1.0::DOUBLE / n), 6) AS v FROM c JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4")
def perm1_marginal(spark, d):
    m = P.permutation_marginal(members(spark, d), "l_orderkey", ["l_returnflag", "l_linestatus"], 1, table(spark, d, "orders"), "o_orderkey", ("o_orderpriority",))
    return m.withColumn("v", r6("v"))


@query(f"WITH {_MEMBERS}, {_PERM2} SELECT o_orderpriority, n, m0_l_returnflag, m1_l_returnflag, round(sum(w), 6) AS v FROM p JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4")
def perm2_marginal(spark, d):
    m = P.permutation_marginal(members(spark, d), "l_orderkey", ["l_returnflag"], 2, table(spark, d, "orders"), "o_orderkey", ("o_orderpriority",))
    return m.withColumn("v", r6("v"))


@query(f"""WITH {_MEMBERS}, p AS (SELECT a.n, a.l_returnflag AS m0_l_returnflag, b.l_returnflag AS m1_l_returnflag, e.l_returnflag AS m2_l_returnflag, 1.0::DOUBLE / (a.n * greatest(a.n - 1, 1) * greatest(a.n - 2, 1)) AS w
    FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND (a.rn <> b.rn OR a.n = 1)
    JOIN c e ON a.l_orderkey = e.l_orderkey AND ((a.n > 2 AND e.rn <> a.rn AND e.rn <> b.rn) OR (a.n <= 2 AND e.rn = a.rn)))
    SELECT n, m0_l_returnflag, m1_l_returnflag, m2_l_returnflag, round(sum(w), 6) AS v FROM p GROUP BY 1, 2, 3, 4""")
def perm3_marginal(spark, d):
    return P.permutation_marginal(members(spark, d), "l_orderkey", ["l_returnflag"], 3).withColumn("v", r6("v"))


@query("SELECT DISTINCT l_orderkey, 1.0::DOUBLE AS total FROM lineitem")
def perm_weights_sum(spark, d):
    return P.permutations(members(spark, d), "l_orderkey", [], 2).groupBy("l_orderkey").agg(r6(F.sum("weight")).alias("total"))


# ---- marginals ---------------------------------------------------------------------------------


@query("""SELECT c_mktsegment, o_orderstatus, o_orderpriority, count(*)::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def pair_marginal_customer_orders(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return M.marginal(j, ["c_mktsegment", "o_orderstatus", "o_orderpriority"])


@query("""SELECT s.o_orderstatus, p.o_orderpriority, y.y, coalesce(v, 0)::DOUBLE AS v FROM (SELECT DISTINCT o_orderstatus FROM orders) s, (SELECT DISTINCT o_orderpriority FROM orders) p, (SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders) y
    LEFT JOIN (SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INT AS y, count(*) AS v FROM orders GROUP BY 1, 2, 3) m ON m.o_orderstatus = s.o_orderstatus AND m.o_orderpriority = p.o_orderpriority AND m.y = y.y""")
def marginal_dense(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"))
    attrs = ["o_orderstatus", "o_orderpriority", "y"]
    return M.densify(M.marginal(o, attrs), {a: o.select(a).distinct() for a in attrs})


@query("SELECT o_orderpriority, count(*)::DOUBLE AS v FROM orders GROUP BY 1")
def marginal_project(spark, d):
    return M.project(M.marginal(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]), ["o_orderpriority"])


@query("""SELECT 'l_linestatus,l_returnflag' AS marginal, l_linestatus, l_returnflag, CAST(NULL AS VARCHAR) AS l_linenumber, count(*)::DOUBLE AS v FROM lineitem GROUP BY 2, 3
    UNION ALL SELECT 'l_linenumber,l_returnflag', NULL, l_returnflag, l_linenumber::VARCHAR, count(*)::DOUBLE FROM lineitem GROUP BY 3, 4""")
def marginal_grouping_sets(spark, d):
    return M.many_marginals(table(spark, d, "lineitem"), [("l_linestatus", "l_returnflag"), ("l_linenumber", "l_returnflag")])


_M1 = f"{_MEMBERS}, g AS (SELECT n AS size, l_returnflag, round(sum(1.0::DOUBLE / n), 9) AS v FROM c GROUP BY 1, 2), h AS (SELECT size, count(*) AS n_groups FROM (SELECT l_orderkey, max(n) AS size FROM c GROUP BY 1) GROUP BY 1)"


def _size_marginal(spark, d):
    m = P.permutation_marginal(members(spark, d), "l_orderkey", ["l_returnflag"], 1)
    return m.select(F.col("n").alias("size"), F.col("m0_l_returnflag").alias("l_returnflag"), F.round("v", 9).alias("v"))


def _histogram(spark, d):
    return G.size_histogram(table(spark, d, "lineitem"), "l_orderkey", CAP)


@query(f"WITH {_M1} SELECT size, l_returnflag, round(CASE WHEN size <= 2 THEN 0 ELSE v END, 6) AS v FROM g")
def legalize_marginal(spark, d):
    return M.legalise(_size_marginal(spark, d), 2).withColumn("v", r6("v"))


@query(f"WITH {_M1} SELECT least(size, 4) AS size, l_returnflag, round(sum(v), 6) AS v FROM g GROUP BY 1, 2")
def size_bin_merge(spark, d):
    return M.merge_sizes(_size_marginal(spark, d), ["l_returnflag"], 4).withColumn("v", r6("v"))


@query(f"WITH {_M1}, b AS (SELECT least(size, 4) AS bin, l_returnflag, sum(v) AS v FROM g GROUP BY 1, 2), s AS (SELECT size, least(size, 4) AS bin, n_groups / sum(n_groups) OVER (PARTITION BY least(size, 4)) AS share FROM h) SELECT size, l_returnflag, round(v * share, 6) AS v FROM b JOIN s USING (bin)")
def size_bin_back(spark, d):
    merged = M.merge_sizes(_size_marginal(spark, d), ["l_returnflag"], 4)
    return M.unmerge_sizes(merged, ["l_returnflag"], 4, _histogram(spark, d)).withColumn("v", r6("v"))


@query(f"WITH {_M1} SELECT g.size, l_returnflag, round(v * (n_groups + 1) / sum(v) OVER (PARTITION BY g.size), 6) AS v FROM g JOIN h ON g.size = h.size")
def normalize_by_size(spark, d):
    h = _histogram(spark, d).withColumn("n_groups", F.col("n_groups") + 1)
    return M.normalise_by_size(_size_marginal(spark, d), h).withColumn("v", r6("v"))


@query("""WITH m AS (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), t AS (SELECT l_returnflag, count(*)::DOUBLE AS t FROM lineitem GROUP BY 1)
    SELECT m.l_returnflag, l_linestatus, round(v * t / sum(v) OVER (PARTITION BY m.l_returnflag), 6) AS v FROM m JOIN t ON m.l_returnflag = t.l_returnflag""")
def ipf_scale(spark, d):
    li = table(spark, d, "lineitem")
    m = M.marginal(li.filter("l_linenumber <= 3"), ["l_returnflag", "l_linestatus"])
    return M.scale_along(m, ["l_returnflag"], M.marginal(li, ["l_returnflag"])).withColumn("v", r6("v"))


_ATTRS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]
_PAIRS = [(a, b) for i, a in enumerate(_ATTRS) for b in _ATTRS[i + 1 :]]


def _pair_sql(part) -> str:
    return " UNION ALL ".join(part(a, b) for a, b in _PAIRS)


@query(_pair_sql(lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, round(sum(abs(coalesce(v, 0) - nx * ny / n)) / 2, 6) AS score FROM (SELECT {a} AS x, count(*)::DOUBLE AS nx FROM lineitem GROUP BY 1) CROSS JOIN (SELECT {b} AS y, count(*)::DOUBLE AS ny FROM lineitem GROUP BY 1) CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM lineitem) LEFT JOIN (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2) USING (x, y)"))
def r_scores_all_pairs(spark, d):
    return M.r_scores(M.pair_counts(table(spark, d, "lineitem"), _ATTRS)).withColumn("score", r6("score"))


@query(f"""WITH {_MEMBERS}, {_PERM2}, q AS (SELECT m0_l_returnflag AS x, m1_l_returnflag AS y, sum(w) AS v FROM p WHERE n > 1 GROUP BY 1, 2),
    j AS (SELECT v, sum(v) OVER (PARTITION BY x) AS nx, sum(v) OVER (PARTITION BY y) AS ny, sum(v) OVER () AS n FROM q)
    SELECT 'm0_l_returnflag' AS a, 'm1_l_returnflag' AS b, round((sum(abs(v - nx * ny / n)) + max(n) - sum(nx * ny / n)) / 2 / max(n), 6) AS score FROM j""")
def intra_group_r_scores(spark, d):
    p = P.permutations(members(spark, d), "l_orderkey", ["l_returnflag"], 2).filter("n > 1")
    joint = M.pair_counts(p, ["m0_l_returnflag", "m1_l_returnflag"], F.col("weight"))
    total = p.agg(F.sum("weight").alias("t"))
    return M.r_scores(joint).join(F.broadcast(total)).select("a", "b", r6(F.col("score") / F.col("t")).alias("score"))


@query(_pair_sql(lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, round(sum(v / n * ln(v * n / (nx * ny))), 6) AS mi FROM (SELECT v, sum(v) OVER (PARTITION BY x) AS nx, sum(v) OVER (PARTITION BY y) AS ny, sum(v) OVER () AS n FROM (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2))"))
def mutual_information(spark, d):
    return M.mutual_information(M.pair_counts(table(spark, d, "lineitem"), _ATTRS)).withColumn("mi", r6("mi"))


@query("SELECT round(ln(sum(v)) - sum(v * ln(v)) / sum(v), 6) AS h FROM (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2)")
def entropy(spark, d):
    return M.entropy(M.marginal(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])).select(r6("h").alias("h"))


_TWO = "(SELECT {0} AS k, count(*)::DOUBLE AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT {0} AS k, count(*)::DOUBLE AS y FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b USING (k)"


def _halves(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1")


@query(f"SELECT round(sum(abs(coalesce(x, 0) - coalesce(y, 0))) / 2, 6) AS distance, round(sum(abs(coalesce(x, 0) - coalesce(y, 0))) / 2 / sum(x), 6) AS ratio FROM {_TWO.format('o_orderpriority')}")
def tvd_two_tables(spark, d):
    a, b = _halves(spark, d)
    return M.tvd(M.marginal(a, ["o_orderpriority"]), M.marginal(b, ["o_orderpriority"]), ["o_orderpriority"]).select(r6("distance").alias("distance"), r6("ratio").alias("ratio"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS attr, round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS distance FROM (SELECT x / sum(x) OVER () AS p, y / sum(y) OVER () AS q FROM {_TWO.format(a)})" for a in ("o_orderpriority", "o_orderstatus")))
def attr_tvd(spark, d):
    return M.attr_tvd(*_halves(spark, d), ["o_orderpriority", "o_orderstatus"]).withColumn("distance", r6("distance"))


_COMP = "(SELECT key, count(*) AS n FROM (SELECT {0}, string_agg(concat_ws('x', v, k), ',' ORDER BY concat_ws('x', v, k)) AS key FROM (SELECT {0}, {1} AS v, count(*) AS k FROM {2} GROUP BY 1, 2) GROUP BY 1) GROUP BY 1)"


@query(f"SELECT * FROM {_COMP.format('l_orderkey', 'l_returnflag', 'lineitem')}")
def group_composition(spark, d):
    return M.composition(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query(f"WITH a AS (SELECT key, n / sum(n) OVER () AS p FROM {_COMP.format('l_orderkey', 'l_returnflag', '(SELECT * FROM lineitem WHERE l_orderkey % 2 = 0)')}), b AS (SELECT key, n / sum(n) OVER () AS q FROM {_COMP.format('l_orderkey', 'l_returnflag', '(SELECT * FROM lineitem WHERE l_orderkey % 2 = 1)')}) SELECT round(sum(greatest(p - coalesce(q, 0), 0)), 6) AS distance FROM a LEFT JOIN b USING (key)")
def group_composition_tvd(spark, d):
    li = table(spark, d, "lineitem")
    c = [M.composition(li.filter(f"l_orderkey % 2 = {k}"), "l_orderkey", "l_returnflag") for k in (0, 1)]
    return M.one_sided_tvd(*c).select(r6("distance").alias("distance"))


@query("WITH a AS (SELECT o_orderpriority AS k, count(*)::DOUBLE AS x FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*)::DOUBLE AS y FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) SELECT round(sum(abs(coalesce(x, 0) - coalesce(y, 0))) / 2, 6) AS distance, round(sum(abs(coalesce(x, 0) - coalesce(y, 0))) / 2 / sum(coalesce(x, 0)), 6) AS ratio FROM a FULL JOIN b USING (k)")
def marginal_consistency(spark, d):
    o = table(spark, d, "orders")
    a, b = M.marginal(o, ["o_orderstatus", "o_orderpriority"]), M.marginal(o.filter("o_custkey % 2 = 0").withColumn("y", F.year("o_orderdate")), ["o_orderpriority", "y"])
    return M.inconsistent(a, b, ["o_orderpriority"], 1e-9).select(r6("distance").alias("distance"), r6("ratio").alias("ratio"))
