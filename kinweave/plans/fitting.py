"""Queries over models fitted to overlapping marginals: the fit, the choice of marginals, redrawn columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import codecs, factors, groups, junction, latent, marginals, sampling
from kinweave.plans.model import _GAUSS
from kinweave.plans.relational import _MD5, query, r6
from kinweave.sources.tables import table

DOMAIN = {"o_orderstatus": codecs.STATUS, "o_orderpriority": codecs.PRIORITY, "y": list(range(1995, 2002)), "q": [1, 2, 3, 4]}
#: Three of them form a cycle, so that they have to be fitted in rounds; the fourth has a clique of its own.
FITTED = [("o_orderpriority", "o_orderstatus"), ("o_orderpriority", "y"), ("o_orderstatus", "y"), ("q", "y")]
ROUNDS = 4
#: What is chosen from: all sets of two and three attributes within the two cliques.
CANDIDATES = [*FITTED, ("o_orderpriority", "o_orderstatus", "y")]
_SEED, _ERROR_NOISE, _CELL_NOISE = 4, 2.0, 1.0
_O = "o AS (SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q FROM orders)"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))


def _joint_sql() -> str:
    """Proportional fitting of the joint table, step by step; the cliques' order is that of the tree."""
    axes = " CROSS JOIN ".join(f"(SELECT unnest({values}) AS {a})" for a, values in DOMAIN.items())
    ctes, last = [_O, f"j0 AS MATERIALIZED (SELECT *, (SELECT count(*) FROM o)::DOUBLE / count(*) OVER () AS v FROM {axes})"], "j0"
    for k in range(ROUNDS * len(FITTED)):
        s = ", ".join(FITTED[k % len(FITTED)])
        ctes.append(f"j{k + 1} AS MATERIALIZED (SELECT {', '.join(DOMAIN)}, CASE WHEN s > 0 THEN v * t / s ELSE 0 END AS v FROM (SELECT *, sum(v) OVER (PARTITION BY {s}) AS s FROM {last}) JOIN (SELECT {s}, count(*)::DOUBLE AS t FROM o GROUP BY {s}) USING ({s}))")
        last = f"j{k + 1}"
    return "WITH " + ", ".join(ctes) + f" SELECT o_orderpriority, o_orderstatus, y, round(sum(v), 4) AS v FROM {last} GROUP BY 1, 2, 3"


@query(_joint_sql())
def fit_junction_tree(spark, d):
    """A clique's table after fitting overlapping marginals over the tree; DuckDB fits the joint table."""
    o = _orders(spark, d)
    tree = junction.JunctionTree(o, DOMAIN, FITTED, float(o.count()))
    tree.fit({s: marginals.marginal(o, list(s)) for s in FITTED}, ROUNDS)
    return tree.tables[tree.home(("o_orderpriority", "o_orderstatus", "y"))].select("o_orderpriority", "o_orderstatus", "y", F.round("v", 4).alias("v"))


def _start(o):
    """A model of the attributes' own counts."""
    tree = junction.JunctionTree(o, DOMAIN, CANDIDATES, float(o.count()))
    measured = {(a,): marginals.marginal(o, [a]) for a in DOMAIN}
    tree.fit(measured, 1)
    return tree, measured


def _error_sql(s: tuple[str, ...]) -> str:
    names, key = ", ".join(s), ",".join(s)
    shares = " CROSS JOIN ".join(f"(SELECT {a}, count(*)::DOUBLE AS n_{a} FROM o GROUP BY 1)" for a in s)
    free = " * ".join(f"n_{a}" for a in s) + " / pow((SELECT count(*) FROM o), " + str(len(s) - 1) + ")"
    z = f"round({_GAUSS.format(f'({_SEED} || ' + repr('#round 0#' + key) + ')')}, 6)"
    return f"SELECT '{key}' AS marginal, sum(abs(coalesce(v, 0) - {free})) / 2 + {_ERROR_NOISE} * max({z}) AS error FROM {shares} LEFT JOIN (SELECT {names}, count(*)::DOUBLE AS v FROM o GROUP BY {names}) USING ({names})"


@query(f"WITH {_O}, e AS ({' UNION ALL '.join(map(_error_sql, CANDIDATES))}) SELECT marginal, round(error, 4) AS error, row_number() OVER (ORDER BY error DESC, marginal) <= 2 AS chosen FROM e")
def select_marginals_first(spark, d):
    """The first round: errors of all candidates under independence, and the two that are chosen."""
    o = _orders(spark, d)
    tree, measured = _start(o)
    out = junction.select_marginals(o, tree, measured, CANDIDATES, [2], _ERROR_NOISE, _CELL_NOISE, _SEED, fit_rounds=1)
    return spark.createDataFrame([(",".join(c.marginal), round(c.error, 4), c.chosen) for c in out], "marginal string, error double, chosen boolean")


@query()
def select_marginals(spark, d):
    """Marginals chosen in three rounds with a fit after each, and their errors when they were chosen from."""
    o = _orders(spark, d)
    tree, measured = _start(o)
    out = junction.select_marginals(o, tree, measured, CANDIDATES, [1, 1, 1], _ERROR_NOISE, _CELL_NOISE, _SEED, fit_rounds=3)
    return spark.createDataFrame([(c.round, ",".join(c.marginal), c.error, c.chosen) for c in out], "round int, marginal string, error double, chosen boolean")


# ---- redrawn columns, groups from sizes, classes -----------------------------------------------

_DRAW = _MD5.format("'r#' || o_orderkey")


@query(f"""WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, year(o_orderdate)::INT AS y FROM orders),
    f AS (SELECT s, p, ln(count(*)) AS v FROM o GROUP BY 1, 2), g AS (SELECT p, y, ln(count(*)) AS v FROM o GROUP BY 1, 2),
    c AS (SELECT s, y, p, f.v + g.v AS e FROM (SELECT DISTINCT s, y FROM o) JOIN f USING (s) JOIN g USING (y, p)),
    x AS (SELECT *, exp(e - max(e) OVER (PARTITION BY s, y)) AS w FROM c), n AS (SELECT *, floor(w / sum(w) OVER (PARTITION BY s, y) * 1e9 + 0.5)::BIGINT AS n FROM x),
    h AS (SELECT *, sum(n) OVER (PARTITION BY s, y ORDER BY p) AS hi, sum(n) OVER (PARTITION BY s, y) AS t FROM n)
    SELECT o_orderkey, s AS o_orderstatus, y, h.p AS o_orderpriority FROM o JOIN h USING (s, y) WHERE {_DRAW}::HUGEINT * t >= (hi - n)::HUGEINT * 4294967296 AND {_DRAW}::HUGEINT * t < hi::HUGEINT * 4294967296""")
def resample_column(spark, d):
    """Priorities drawn anew from the product of two factors, by status and by year."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("y"), "o_orderpriority")
    factors = [marginals.marginal(o, s).withColumn("v", F.log("v")) for s in (["o_orderstatus", "o_orderpriority"], ["o_orderpriority", "y"])]
    return sampling.resample_column(o, "o_orderpriority", factors, F.concat(F.lit("r#"), F.col("o_orderkey").cast("string")))


@query(f"""WITH h AS (SELECT n AS size, unnest(range(1, count(*) + 1)) AS copy FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n),
    g AS (SELECT size, row_number() OVER w - 1 AS "group", sum(size) OVER w - size AS start FROM h WINDOW w AS (ORDER BY {_MD5.format("'6-' || size || '-' || copy")}, size, copy)),
    p AS (SELECT "group", unnest(range(start::BIGINT, (start + size)::BIGINT)) AS place FROM g)
    SELECT o_orderkey, "group" FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_MD5.format("'6#' || o_orderkey")}, o_orderkey) - 1 AS place FROM orders) JOIN p USING (place)""")
def group_ids_from_histogram(spark, d):
    """Orders dealt out to new groups that have the sizes of customers' orders."""
    o = table(spark, d, "orders")
    h = groups.size_histogram(o, "o_custkey").withColumnRenamed("n_groups", "n")
    return groups.group_ids(o.select("o_orderkey"), "o_orderkey", h, 6).select("o_orderkey", "group")


@query("""WITH a AS (SELECT l_orderkey, l_returnflag, count(*) AS have FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), b AS (SELECT l_orderkey, l_returnflag, count(*) AS need FROM lineitem WHERE l_linenumber > 4 GROUP BY 1, 2)
    SELECT l_orderkey, min(coalesce(have, 0) - need) >= 0 AS contained FROM b LEFT JOIN a USING (l_orderkey, l_returnflag) GROUP BY 1""")
def multiset_contains(spark, d):
    """Whether an order's first lines hold the return flags of its later ones, with their counts."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return groups.multiset_contains(li.filter("l_linenumber <= 4"), li.filter("l_linenumber > 4"), "l_orderkey", "l_returnflag")


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, string_agg(c_mktsegment || '=' || n, ',' ORDER BY c_mktsegment) AS entries, true AS same FROM c GROUP BY 1""")
def map_per_key(spark, d):
    """Each nation's customers by segment as a map, equal to the same map with its entries the other way round."""
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    m = groups.map_per_key(c, "c_nationkey", "c_mktsegment", "n")
    turned = F.map_from_entries(F.reverse(F.map_entries("entries")))
    text = F.array_join(F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select("c_nationkey", text.alias("entries"), groups.same_map(F.col("entries"), turned).alias("same"))


_LATENT, _CLASSES, _STEPS = ["l_returnflag", "l_linestatus", "tens"], 2, 3


def _latent_sql() -> str:
    keys = " || '|' || ".join(_LATENT)
    u = "((" + _MD5.format(f"'9#' || k || '#' || {keys}") + ") + 0.5) / 4294967296.0::DOUBLE"
    ctes = [
        f"c AS MATERIALIZED (SELECT {', '.join(_LATENT)}, count(*)::DOUBLE AS v FROM (SELECT *, floor(l_quantity / 10)::INT AS tens FROM lineitem) GROUP BY ALL)",
        f"w0 AS MATERIALIZED (SELECT *, u / sum(u) OVER (PARTITION BY {', '.join(_LATENT)}) AS w FROM (SELECT *, {u} AS u FROM c CROSS JOIN (SELECT unnest(range({_CLASSES})) AS k)))",
    ]
    for i in range(_STEPS):
        ctes.append(f"s{i} AS MATERIALIZED (SELECT k, sum(v * w) AS s FROM w{i} GROUP BY 1)")
        for a in _LATENT:
            ctes.append(f"h{i}_{a} AS MATERIALIZED (SELECT {a}, k, ln((sum(v * w) + 1) / (any_value(s) + (SELECT count(DISTINCT {a}) FROM c))) AS l_{a} FROM w{i} JOIN s{i} USING (k) GROUP BY 1, 2)")
        joins = " ".join(f"JOIN h{i}_{a} USING ({a}, k)" for a in _LATENT)
        ctes.append(f"e{i} AS MATERIALIZED (SELECT {', '.join(_LATENT)}, k, v, ln(s) + {' + '.join(f'l_{a}' for a in _LATENT)} AS e FROM w{i} JOIN s{i} USING (k) {joins})")
        ctes.append(f"w{i + 1} AS MATERIALIZED (SELECT {', '.join(_LATENT)}, k, v, x / sum(x) OVER (PARTITION BY {', '.join(_LATENT)}) AS w FROM (SELECT *, exp(e - max(e) OVER (PARTITION BY {', '.join(_LATENT)})) AS x FROM e{i}))")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT '{a}' AS attr, {a}::VARCHAR AS value, k::INT AS class, round(sum(v * w), 3) AS v FROM w{_STEPS} GROUP BY ALL" for a in _LATENT)


def _classes(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.floor(F.col("l_quantity") / 10).cast("int").alias("tens"))
    return latent.soft_classes(li, _LATENT, _CLASSES, _STEPS, 9)


@query(_latent_sql())
def latent_histogram(spark, d):
    """Lineitems softly assigned to two classes in three steps, and the classes' histograms."""
    return latent.latent_histogram(_classes(spark, d), _LATENT).withColumn("v", F.round("v", 3))


@query(_latent_sql().split("SELECT 'l_returnflag' AS attr")[0] + f"SELECT k::INT AS class, sum(v)::DOUBLE AS v FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(_LATENT)} ORDER BY w DESC, k) AS r FROM w{_STEPS}) WHERE r = 1 GROUP BY 1")
def latent_classes(spark, d):
    """Lineitems by the class that is likeliest for each."""
    return latent.hard_classes(_classes(spark, d)).groupBy("class").agg(F.sum("v").alias("v"))


# ---- factors with domains ----------------------------------------------------------------------

_FA = "(SELECT o_orderstatus, o_orderpriority, coalesce(v, 0) AS a FROM (SELECT unnest(['F', 'O', 'P']) AS o_orderstatus) CROSS JOIN (SELECT unnest({p}) AS o_orderpriority) LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS v FROM orders WHERE o_totalprice > 150000 GROUP BY 1, 2) USING (o_orderstatus, o_orderpriority))".format(p=codecs.PRIORITY)
_FB = "(SELECT o_orderpriority, y, coalesce(v, 0) AS b FROM (SELECT unnest({p}) AS o_orderpriority) CROSS JOIN (SELECT unnest(range(1994, 2002))::INT AS y) LEFT JOIN (SELECT o_orderpriority, year(o_orderdate)::INT AS y, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2) USING (o_orderpriority, y))".format(p=codecs.PRIORITY)
_FC = "(SELECT quarter(o_orderdate)::INT AS q, count(*)::DOUBLE AS c FROM orders GROUP BY 1)"


@query(f"SELECT o_orderstatus, o_orderpriority, y, q, round(CASE WHEN a - 3 <> 0 THEN (exp(ln(a + 1) + ln(b + 2)) - b) / (a - 3) ELSE 0 END * c / 100, 6) AS v FROM {_FA} JOIN {_FB} USING (o_orderpriority) CROSS JOIN {_FC}")
def factor_arithmetic(spark, d):
    """Sums, differences, products, quotients, exp and log of factors over their domains, absent cells included;
    the last factor shares no attribute with the others."""
    o = table(spark, d, "orders").withColumns({"y": F.year("o_orderdate"), "q": F.quarter("o_orderdate")})
    domain = DOMAIN | {"y": list(range(1994, 2002))}
    of = lambda df, *s: factors.Factor(marginals.marginal(df, list(s)), {a: domain[a] for a in s})
    a, b, c = of(o.filter("o_totalprice > 150000"), "o_orderstatus", "o_orderpriority"), of(o, "o_orderpriority", "y"), of(o, "q")
    out = ((((a + 1).log() + (b + 2).log()).exp() - b) / (a - 3)) * (c * 0.01)
    return out.dense().withColumn("v", r6("v"))


@query(f"WITH t AS (SELECT a.o_orderpriority, a, b FROM (SELECT o_orderpriority, sum(a) AS a FROM {_FA} GROUP BY 1) a JOIN (SELECT o_orderpriority, sum(b) AS b FROM {_FB} GROUP BY 1) b USING (o_orderpriority)) SELECT round(sum((a - b) * (a - b)) / 2, 4) AS loss, round(sum(a * b), 4) AS dot, round(max(a) / 1000 + ln(sum(exp((a - m) / 1000))), 6) AS logsum FROM t CROSS JOIN (SELECT max(a) AS m FROM t)")
def factor_distance(spark, d):
    """Loss, inner product and log-sum of two factors over one domain, as one row."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    of = lambda df, *s: factors.Factor(marginals.marginal(df, list(s)), {a: (DOMAIN | {"y": list(range(1994, 2002))})[a] for a in s})
    a = of(o.filter("o_totalprice > 150000"), "o_orderstatus", "o_orderpriority").sum_out(["o_orderpriority"])
    b = of(o, "o_orderpriority", "y").sum_out(["o_orderpriority"])
    one = (a * 0.001).logsumexp([]).dense().select(r6("v").alias("logsum"))
    return a.loss(b).select(F.round("loss", 4).alias("loss")).join(a.dot(b).select(F.round("dot", 4).alias("dot")), how="cross").join(one, how="cross")
