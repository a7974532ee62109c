"""Queries over models: factors, scores, noise, sampling, matching, group queries and the SQL workload."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import columns as C
from kinweave.operators import factors, groups, marginals, permute, privacy, sampling, structure, workload
from kinweave.operators.match import match as match_rows
from kinweave.plans.relational import _ATTRS, _LINE, _MD5, LINE, ORACLE_SQL, QUERIES, query, r6
from kinweave.sources.tables import register, run_sql, table

# ---- factors -----------------------------------------------------------------------------------

_A = "(SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2)"
_B = "(SELECT o_orderpriority, year(o_orderdate)::INT AS y, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2)"


def _ab(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return marginals.marginal(o, ["o_orderstatus", "o_orderpriority"]), marginals.marginal(o, ["o_orderpriority", "y"])


@query(f"SELECT o_orderpriority, o_orderstatus, y, a.v * b.v AS v FROM {_A} a JOIN {_B} b USING (o_orderpriority)")
def factor_product(spark, d):
    return factors.product(list(_ab(spark, d)))


@query(f"SELECT o_orderpriority, round(max(v) / 1000 + ln(sum(exp((v - m) / 1000))), 6) AS v FROM (SELECT *, max(v) OVER (PARTITION BY o_orderpriority) AS m FROM {_A}) GROUP BY 1")
def factor_logsumexp(spark, d):
    a, _ = _ab(spark, d)
    return factors.logsumexp(a.withColumn("v", F.col("v") / 1000), ["o_orderpriority"]).withColumn("v", r6("v"))


@query(f"SELECT o_orderstatus, v FROM {_A} WHERE o_orderpriority = '1-URGENT'")
def factor_condition(spark, d):
    return factors.condition(_ab(spark, d)[0], o_orderpriority="1-URGENT")


@query(f"""WITH j AS (SELECT o_orderstatus, o_orderpriority, y, c.l_quarter, a.v * b.v * c.v AS v FROM {_A} a JOIN {_B} b USING (o_orderpriority) JOIN (SELECT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS l_quarter, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2) c USING (y))
    SELECT l_quarter, y, round(sum(v) / (SELECT sum(v) FROM j), 9) AS v FROM j GROUP BY 1, 2""")
def bp_tree_marginals(spark, d):
    o = table(spark, d, "orders").withColumns({"y": F.year("o_orderdate"), "l_quarter": F.quarter("o_orderdate")})
    cliques = {n: marginals.marginal(o, a) for n, a in {"a": ["o_orderstatus", "o_orderpriority"], "b": ["o_orderpriority", "y"], "c": ["y", "l_quarter"]}.items()}
    return factors.normalised(factors.tree_marginals(cliques, [("a", "b"), ("b", "c")])["c"]).select("l_quarter", "y", F.round("v", 9).alias("v"))


# ---- structure ---------------------------------------------------------------------------------


def _edges(spark, d):
    return marginals.r_scores(marginals.pair_counts(table(spark, d, "lineitem"), _ATTRS)).withColumn("score", F.round("score", 4))


_EDGES = "e AS (SELECT a, b, round(score, 4) AS score FROM (" + ORACLE_SQL["r_scores_all_pairs"] + "))"


@query(f"WITH {_EDGES} SELECT a, b, score FROM e ORDER BY score DESC, a, b LIMIT 3")
def topk_edges(spark, d):
    return structure.top_edges(_edges(spark, d), 3)


@query(f"""WITH {_EDGES}, t AS (SELECT
    sum(CASE WHEN (a = 'l_returnflag' AND b IN ('l_linestatus', 'l_linenumber')) OR (b = 'l_returnflag' AND a IN ('l_linestatus', 'l_linenumber')) THEN score ELSE 0 END) AS g1,
    sum(CASE WHEN a IN ('l_linestatus', 'l_linenumber') AND b IN ('l_linestatus', 'l_linenumber') THEN score ELSE 0 END) AS i1,
    sum(CASE WHEN (a = 'l_returnflag' AND b = 'l_quantity') OR (b = 'l_returnflag' AND a = 'l_quantity') THEN score ELSE 0 END) AS g2 FROM e)
    SELECT 's1' AS set_name, round(g1 / sqrt(greatest(2 * (2 + i1), 1)), 6) AS score FROM t UNION ALL SELECT 's2', round(g2 / sqrt(greatest(2 * 1, 1)), 6) FROM t""")
def cfs_scores(spark, d):
    return structure.cfs_scores(_edges(spark, d), "l_returnflag", {"s1": ["l_linestatus", "l_linenumber"], "s2": ["l_quantity"]}).withColumn("score", r6("score"))


# ---- privacy -----------------------------------------------------------------------------------

_U = "((" + _MD5 + " + 0.5) / 4294967296.0::DOUBLE)"
_GAUSS = f"(sqrt(-2 * ln({_U.format('{0} || ' + repr('a'))})) * cos(2 * pi() * {_U.format('{0} || ' + repr('b'))}))"


@query(f"WITH h AS (SELECT size, count(*) AS n FROM (SELECT l_orderkey, least(count(*), 7) AS size FROM lineitem GROUP BY 1) GROUP BY 1) SELECT size, round(CASE WHEN n + 4.0 * g < 0 THEN 2.0 ELSE n + 4.0 * g END, 6) AS v FROM (SELECT size, n, {_GAUSS.format('size::VARCHAR')} AS g FROM h)")
def noisy_size_hist(spark, d):
    h = groups.size_histogram(table(spark, d, "lineitem"), "l_orderkey", 7)
    return privacy.noisy_sizes(h, privacy.sigma(2, 0.25), F.col("size").cast("string")).withColumn("v", r6("v"))


@query(f"SELECT o_orderstatus, o_orderpriority, round(v + 4.0 * {_GAUSS.format('(o_orderstatus || o_orderpriority)')}, 6) AS v FROM {_A}")
def noisy_marginal(spark, d):
    return privacy.noisy(_ab(spark, d)[0], privacy.sigma(1, 0.25, 4), F.concat("o_orderstatus", "o_orderpriority")).withColumn("v", r6("v"))


@query("SELECT 2::INT AS sensitivity, count(*)::INT AS queries, round(sqrt(pow(2, 2) * count(*) / 0.25), 6) AS sigma FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
def gaussian_sigma(spark, d):
    """The noise of one count for each pair of flags that lineitems have, under one budget."""
    n = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct().count()
    return spark.createDataFrame([(2, n, round(privacy.sigma(2, 0.25, n), 6))], "sensitivity int, queries int, sigma double")


@query()
def privacy_budget(spark, d):
    """Budgets at a delta of one in the orders."""
    delta = 1.0 / max(2, table(spark, d, "orders").count())
    rows = [(e, delta, privacy.privacy_budget(e, delta)) for e in (0.1, 0.2, 0.8, 3.2)]
    return spark.createDataFrame(rows, "epsilon double, delta double, budget double")


_BY_SIZE = """m0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {line}) AS rn FROM lineitem), m1 AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM m0 WHERE rn <= 7),
    m AS (SELECT size, flag, round(coalesce(v, 0), 6) AS v FROM (SELECT unnest(range(1, 8)) AS size) CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS flag) LEFT JOIN (SELECT n AS size, l_returnflag AS flag, sum(1.0::DOUBLE / n) AS v FROM m1 GROUP BY 1, 2) USING (size, flag)),
    h AS (SELECT size, round(CASE WHEN n + 4.0 * g < 0 THEN 2.0 ELSE n + 4.0 * g END, 6) AS n FROM (SELECT size, count(*) AS n FROM (SELECT least(count(*), 7) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY 1) JOIN (SELECT s AS size, {g_size} AS g FROM (SELECT unnest(range(1, 8)) AS s)) USING (size)),
    s AS (SELECT size, least(size, {low}) AS bin, n / sum(n) OVER (PARTITION BY least(size, {low})) AS share FROM h),
    g AS (SELECT least(size, {low}) AS bin, flag, sum(v) AS v FROM m GROUP BY 1, 2),
    b AS (SELECT size, flag, g.v * share AS v FROM g JOIN s USING (bin)),
    c AS (SELECT {per} * (3 * {low}) + 2 * (sum(abs(m.v - b.v)) / 2 + {bias} * {g_bias}) < {per} * 21 AS merged FROM m JOIN b USING (size, flag)),
    x AS (SELECT size, flag, greatest(v + {noise} * {g_cell}, 0) AS v FROM m),
    y AS (SELECT size, flag, greatest(v + {noise} * z, 0) * share AS v FROM (SELECT bin, flag, v, {g_bin} AS z FROM g) JOIN s USING (bin)),
    r AS (SELECT size, flag, v, merged FROM x CROSS JOIN c WHERE NOT merged UNION ALL SELECT size, flag, v, merged FROM y CROSS JOIN c WHERE merged)
    SELECT size, flag, round(CASE WHEN t > 0 THEN v * n / t ELSE 0 END, 4) AS v, merged FROM (SELECT *, sum(v) OVER (PARTITION BY size) AS t FROM r) JOIN h USING (size)"""


def _by_size_sql(low: int, noise: float, bias: float) -> str:
    g = lambda key: _GAUSS.format(key)
    per = repr(noise * (2 / 3.141592653589793) ** 0.5) + "::DOUBLE"
    return "WITH " + _BY_SIZE.format(line=_LINE, low=low, noise=noise, bias=bias, per=per, g_size=g("s::VARCHAR"), g_bias=g("'bias'"), g_cell=g("(size || '|' || flag)"), g_bin=g("(bin || '|' || flag)"))


def _size_marginal(spark, d, low, noise, bias):
    li = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    c = permute.numbered(li, "l_orderkey", [F.col("flag" if x == "l_returnflag" else x) for x in LINE], 7)
    m = c.groupBy(F.col("n").alias("size"), "flag").agg(F.sum(1.0 / F.col("n")).alias("v"))
    m = marginals.filled(m, {"size": list(range(1, 8)), "flag": ["A", "N", "R"]}).withColumn("v", F.round("v", 6))
    h = privacy.noisy_sizes(groups.size_histogram(li, "l_orderkey", 7), privacy.sigma(2, 0.25), F.col("size").cast("string")).select("size", r6("v").alias("n_groups"))
    got, merged = privacy.measured_by_size(m, ["flag"], low, h, noise, bias, F.concat_ws("|", "size", "flag"))
    return got.select("size", "flag", F.round("v", 4).alias("v"), F.lit(merged).alias("merged"))


@query(_by_size_sql(5, 40.0, 1.0))
def noisy_size_marginal_merged(spark, d):
    """A marginal by group size with noise so large that merging sizes pays."""
    return _size_marginal(spark, d, 5, 40.0, 1.0)


@query(_by_size_sql(5, 0.5, 1.0))
def noisy_size_marginal(spark, d):
    """The same with little noise: sizes stay apart."""
    return _size_marginal(spark, d, 5, 0.5, 1.0)


_PLANNED = [("l_returnflag",), ("l_returnflag", "l_linestatus"), ("l_linenumber", "l_quantity", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{','.join(s)}' AS marginal, cells::BIGINT AS cells, round({7 * 10 / 0.2 ** 0.5 * 3 ** 0.5!r}::DOUBLE, 6) AS noise, round(cells * pow({7 * 10 / 0.2 ** 0.5 * 3 ** 0.5!r}::DOUBLE, 2), 2) AS expected_loss, cells <= least(5e4, n / ({7 * 10 / 0.2 ** 0.5 * 3 ** 0.5!r}::DOUBLE * sqrt(2 / pi())) / 4) AS allowed FROM (SELECT {' * '.join(f'count(DISTINCT {a})' for a in s)} AS cells, count(*) AS n FROM lineitem)" for s in _PLANNED))
def measurement_plan(spark, d):
    """What marginals of lineitems would cost under one budget: rows are protected by customer, whose orders and
    lineitems are capped, so a count's sensitivity is the product of the caps."""
    li = table(spark, d, "lineitem")
    ledger = privacy.Ledger(0.421, {"marginals": 0.5, "other": 0.5})
    noise = privacy.sigma(privacy.sensitivity([10, 7]), ledger.charge("marginals", 0.2), len(_PLANNED))
    sizes = li.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(a).alias(a) for a in sorted({a for s in _PLANNED for a in s})]).first()
    limit, rows = privacy.domain_limit(sizes.n, noise, 4), []
    for s in _PLANNED:
        cells = structure.cells(s, sizes.asDict())
        rows.append((",".join(s), cells, round(noise, 6), round(privacy.theoretic_loss(cells, noise), 2), cells <= limit))
    return spark.createDataFrame(rows, "marginal string, cells long, noise double, expected_loss double, allowed boolean")


@query(f"SELECT a, b, round(greatest(score + {privacy.sigma(2, 0.4, 15)!r}::DOUBLE * {_GAUSS.format(repr('edge|') + ' || a || ' + repr('|') + ' || b')}, 0), 4) AS score FROM ({ORACLE_SQL['r_scores_all_pairs']})")
def noisy_edge_scores(spark, d):
    """Dependence scores with noise for as many queries as pairs; negative ones become 0."""
    scores = marginals.r_scores(marginals.pair_counts(table(spark, d, "lineitem"), _ATTRS))
    noisy = F.round("score", 6) + F.lit(privacy.sigma(2, 0.4, 15)) * C.md5_gauss(F.concat_ws("|", F.lit("edge"), "a", "b"))
    return scores.select("a", "b", F.round(F.greatest(noisy, F.lit(0.0)), 4).alias("score"))


@query()
def model_structure(spark, d):
    """From scores to structure: the graph that the strongest pairs make within limits of cells, its cliques and
    tree, candidate marginals, each attribute's best set, and how many to choose a round."""
    scores = [(r.a, r.b, r.score) for r in _edges(spark, d).collect()]
    li = table(spark, d, "lineitem")
    domain = li.agg(*[F.count_distinct(a).alias(a) for a in _ATTRS]).first().asDict()
    graph = structure.grow_graph(domain, scores, 2_000, 10_000)
    cliques = structure.maximal_cliques(graph)
    found = structure.candidates(cliques, domain, 3, 1_000)
    table_of = {frozenset((a, b)): s for a, b, s in scores}
    rows = [("clique", k, ",".join(sorted(c))) for k, c in enumerate(cliques)] + [("tree", k, f"{a}-{b}") for k, (a, b) in enumerate(structure.junction_tree(cliques))]
    rows += [("candidate", k, ",".join(s)) for k, s in enumerate(found)]
    rows += [("best", k, f"{a}: {','.join(structure.best_set(a, found, table_of) or ())}") for k, a in enumerate(sorted(domain))]
    rows += [("round", k, str(n)) for k, n in enumerate(structure.schedule(len(found), 3))]
    return spark.createDataFrame(rows, "item string, number int, value string")


# ---- sampling ----------------------------------------------------------------------------------

_ROUND = """e AS (SELECT k, val, floor(ex) AS f, ex - floor(ex) AS fr, n FROM (SELECT k, val, n, round(v / sum(v) OVER (PARTITION BY k) * n, 9) AS ex FROM p)),
    r AS (SELECT k, val, f, n - sum(f) OVER (PARTITION BY k) AS rest, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN fr > 0 THEN ln(""" + _U.format("k::VARCHAR || '|' || val") + """) / fr ELSE -1e300 END DESC, val) AS i FROM e),
    x AS (SELECT k, val, (f + CASE WHEN i <= rest THEN 1 ELSE 0 END)::BIGINT AS n_drawn FROM r)"""


@query(f"WITH p AS (SELECT c_nationkey AS k, c_mktsegment AS val, count(*)::DOUBLE AS v, 17 AS n FROM customer GROUP BY 1, 2), {_ROUND} SELECT k AS c_nationkey, val AS c_mktsegment, n_drawn FROM x")
def random_round(spark, d):
    p = marginals.marginal(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"]).withColumn("n", F.lit(17))
    return sampling.random_round(p, ["c_nationkey"], "c_mktsegment", "n", F.concat_ws("|", "c_nationkey", "c_mktsegment"))


@query("SELECT n_nationkey, unnest(range(1, n_regionkey + 1)) AS copy FROM nation WHERE n_regionkey > 0")
def expand_counts(spark, d):
    return sampling.expand(table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("n")), "n").select("n_nationkey", "copy")


@query(f"""WITH w AS (SELECT c_nationkey AS k, c_mktsegment AS val, count(*)::DOUBLE AS v FROM customer GROUP BY 1, 2), z AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1),
    p AS (SELECT k, val, v, n FROM w JOIN z USING (k)), {_ROUND.replace('k::VARCHAR', 'k::VARCHAR')},
    g AS (SELECT k, val, sum(n_drawn) OVER (PARTITION BY k ORDER BY val) AS hi, n_drawn FROM x),
    o AS (SELECT s_suppkey, s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY {_MD5.format('s_suppkey')}, s_suppkey) - 1 AS i FROM supplier)
    SELECT s_suppkey, o.k AS nation, val AS segment FROM o JOIN g ON o.k = g.k AND i >= hi - n_drawn AND i < hi""")
def conditional_fill(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    w = marginals.marginal(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), ["nation", "segment"])
    return sampling.conditional_fill(rows, ["nation"], "s_suppkey", w, "segment").select("s_suppkey", "nation", "segment")


@query(f"""WITH w AS (SELECT o_orderpriority AS val, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT val, sum(n) OVER (ORDER BY val) AS hi, n, sum(n) OVER () AS t FROM w)
    SELECT c_custkey, val AS priority FROM (SELECT c_custkey, {_MD5.format('c_custkey')} AS u FROM customer) JOIN g ON u::HUGEINT * t >= (hi - n)::HUGEINT * 4294967296 AND u::HUGEINT * t < hi::HUGEINT * 4294967296""")
def inverse_cdf_draw(spark, d):
    w = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    rows = table(spark, d, "customer").select("c_custkey", F.lit(1).alias("one"))
    return sampling.inverse_cdf(rows, ["one"], F.col("c_custkey"), w, "priority").select("c_custkey", "priority")


# ---- matching ----------------------------------------------------------------------------------


def _match_sql() -> str:
    side = lambda n, key, src: f"{n}0 AS (SELECT {key} AS id, nation, bal, '' AS bk FROM {src})"
    out = [side("a", "c_custkey", "(SELECT c_custkey, c_nationkey AS nation, floor(c_acctbal / 1000)::INT AS bal FROM customer)"), side("b", "s_suppkey", "(SELECT s_suppkey, s_nationkey AS nation, floor(s_acctbal / 1000)::INT AS bal FROM supplier)")]
    for i, c in enumerate(("nation", "bal")):
        out.append(f"n{i} AS (SELECT bk, {c}, least(x.n, y.n) AS k FROM (SELECT bk, {c}, count(*) AS n FROM a{i} GROUP BY 1, 2) x JOIN (SELECT bk, {c}, count(*) AS n FROM b{i} GROUP BY 1, 2) y USING (bk, {c}))")
        for s in "ab":
            out.append(f"{s}{i + 1} AS (SELECT id, nation, bal, bk || '/' || CASE WHEN r <= coalesce(k, 0) THEN '=' || {c}::VARCHAR ELSE '*' END AS bk FROM (SELECT *, row_number() OVER (PARTITION BY bk, {c} ORDER BY id) AS r FROM {s}{i}) LEFT JOIN n{i} USING (bk, {c}))")
    num = lambda s: f"(SELECT id, bk, row_number() OVER (PARTITION BY bk ORDER BY id) AS r FROM {s}2)"
    return "WITH " + ", ".join(out) + f" SELECT x.id AS c_custkey, y.id AS s_suppkey, (length(bk) - length(replace(bk, '=', '')))::INT AS agreed FROM {num('a')} x JOIN {num('b')} y USING (bk, r)"


@query(_match_sql())
def match_two_fk(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 1000).cast("int").alias("bal"))
    b = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 1000).cast("int").alias("bal"))
    return match_rows(a, b, ["nation", "bal"], "c_custkey", "s_suppkey")


# ---- group queries -----------------------------------------------------------------------------

_Q = (
    workload.GroupQuery("one", {"o_orderpriority": ("1-URGENT", "2-HIGH")}, ({"l_returnflag": ("R",)},), 2, 6),
    workload.GroupQuery("two", {"o_orderstatus": ("F", "O")}, ({"l_returnflag": ("R",)}, {"l_linestatus": ("F",)}), 1, 9),
    workload.GroupQuery("same", {}, ({"l_linenumber": (1, 2)}, {"l_linenumber": (1, 2)}), 2, 20),
)


def _q_sql(q: workload.GroupQuery) -> str:
    within = lambda s: " AND ".join([f"{a} IN ({', '.join(repr(x) for x in v)})" for a, v in s.items()] or ["TRUE"])
    met = [within(m) for m in q.members]
    ok = [f"count(*) FILTER ({m}) > 0" for m in met] + ([f"count(*) FILTER (({met[0]}) OR ({met[1]})) > 1"] if len(met) == 2 else [])
    return f"SELECT '{q.name}' AS query, count(*) AS n FROM orders JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING {' AND '.join(ok)} AND count(*) >= {q.low} AND count(*) < {q.high}) ON l_orderkey = o_orderkey WHERE {within(q.parent)}"


def _answer(spark, d, qs):
    return workload.answer(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", list(qs))


@query(_q_sql(_Q[0]))
def grp_query_1ind(spark, d):
    return _answer(spark, d, _Q[:1])


@query(_q_sql(_Q[1]))
def grp_query_2ind(spark, d):
    return _answer(spark, d, _Q[1:2])


@query(_q_sql(_Q[2]))
def grp_query_k_of_attr(spark, d):
    return _answer(spark, d, _Q[2:])


_RANDOM = workload.random_queries(20, {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "o_orderstatus": ["F", "O", "P"]}, {"l_returnflag": ["A", "N", "R"], "l_linenumber": [1, 2, 3, 4, 5, 6, 7]}, 7, 2)


@query(" UNION ALL ".join(map(_q_sql, _RANDOM)))
def grp_query_batch(spark, d):
    return _answer(spark, d, _RANDOM)


@query("SELECT query, round(abs(n - m * 2.0) / greatest(10, n), 6) AS error FROM (" + " UNION ALL ".join(f"SELECT query, n, m FROM ({_q_sql(q)}) CROSS JOIN (SELECT n AS m FROM ({_q_sql(q).replace('FROM lineitem', 'FROM (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0)')}))" for q in _Q) + ")")
def grp_query_error(spark, d):
    half = workload.answer(table(spark, d, "orders"), "o_orderkey", table(spark, d, "lineitem").filter("l_orderkey % 2 = 0"), "l_orderkey", list(_Q))
    return workload.query_errors(_answer(spark, d, _Q), half, 1000.0, 500.0, 0.01).withColumn("error", r6("error"))


@query("SELECT round(avg(coalesce(abs(x - y) / (x + 1e-6), 1)), 6) AS error FROM (SELECT o_orderpriority, count(*) AS x FROM orders GROUP BY 1) LEFT JOIN (SELECT o_orderpriority, count(*) AS y FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) USING (o_orderpriority)")
def sql_error(spark, d):
    o = table(spark, d, "orders")
    count = lambda df: df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return workload.sql_error(count(o), count(o.filter("o_orderstatus <> 'F'")), ["o_orderpriority"], "n").select(r6("error").alias("error"))


# ---- the SQL workload --------------------------------------------------------------------------

#: Shapes of the public TPC-H queries on the columns at hand; the texts run on both engines.
TPCH = {
    "tpch_q04": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= timestamp '1996-07-01' AND o_orderdate < timestamp '1996-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + interval 30 days) GROUP BY o_orderpriority",
    "tpch_q05": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= timestamp '1996-01-01' AND o_orderdate < timestamp '1998-01-01' GROUP BY n_name",
    "tpch_q07": "SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_nationkey < 5 AND n2.n_nationkey < 5 AND n1.n_nationkey <> n2.n_nationkey GROUP BY 1, 2, 3",
    "tpch_q09": "SELECT n_name, CAST(year(o_orderdate) AS INT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - 0.5 * p_retailprice * l_quantity), 2) AS sum_profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%a%' GROUP BY 1, 2",
    "tpch_q12": "SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= timestamp '1996-01-01' AND l_shipdate < timestamp '1997-01-01' AND l_shipdate > o_orderdate GROUP BY l_returnflag",
    "tpch_q14": "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= timestamp '1996-01-01' AND l_shipdate < timestamp '1997-01-01'",
    "tpch_q17": "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 20 AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)",
    "tpch_q19": "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand LIKE '%1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand LIKE '%2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR (p_brand LIKE '%3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)",
}


def _sql_query(text: str):
    def run(spark, d):
        register(spark, d)
        return run_sql(spark, text)

    return run


for _name, _text in TPCH.items():
    QUERIES[_name], ORACLE_SQL[_name] = _sql_query(_text), _text


@query(f"SELECT c_custkey, round({_GAUSS.format('c_custkey::VARCHAR')}, 6) AS g FROM customer")
def md5_gaussian(spark, d):
    return table(spark, d, "customer").select("c_custkey", r6(C.md5_gauss(F.col("c_custkey"))).alias("g"))
