"""Synthesis of a pair of tables: noisy measurements, a model of conditionals, sampled rows, score.

Every step is a Spark job over a table: group sizes and marginals are measured with noise under a
ledger, attributes are ordered by their dependence scores, and each new column is dealt out by the
marginal that holds it and its best predecessors. What the driver handles is per attribute, not per
row: names, domains and scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import groups, marginals, permute, privacy, sampling, structure
from kinweave.plans.relational import query
from kinweave.sources.scratch import saved
from kinweave.sources.tables import table

SHARES = {"scores": 0.1, "sizes": 0.1, "marginals": 0.8}


def _measured(cube: DataFrame, count: str, attrs: list[str], sensitivity: float, budget: float, limit: int, seed: int) -> DataFrame:
    """A noisy marginal over all cells, negatives to 0; written, so that its noise is drawn once."""
    m = marginals.densify(marginals.marginal(cube, attrs, F.col(count).cast("double")), {a: cube.select(a).distinct() for a in attrs}, limit)
    return saved(privacy.noisy(m, privacy.sigma(sensitivity, budget), seed=seed).withColumn("v", F.greatest("v", F.lit(0.0))))


def plan_columns(scores: list[tuple[str, str, float]], domain: dict[str, int], most: int, limit: int) -> list[tuple[str, list[str]]]:
    """[(attribute, the predecessors it is drawn from)]: the order follows the scores; predecessors
    are added by score while the marginal stays within `limit` cells."""
    score = {frozenset((a, b)): s for a, b, s in scores}
    left, done, out = sorted(domain), [], []
    while left:
        t = structure.next_attr(left, done, score, domain)
        chosen: list[str] = []
        for a in sorted(done, key=lambda a: (-score.get(frozenset((a, t)), 0.0), a)):
            if len(chosen) < most and structure.cells([t, a, *chosen], domain) <= limit:
                chosen.append(a)
        out.append((t, chosen))
        left.remove(t)
        done.append(t)
    return out


def synthesise(parent: DataFrame, pk: str, parent_attrs: list[str], child: DataFrame, fk: str, child_attrs: list[str], budget: float, cap: int, most: int = 2, limit: int = 5_000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(parents, children) that resemble the given ones: parents with new keys and attributes, and
    children with their parent's key and attributes drawn given each other and the parent's."""
    ledger = privacy.Ledger(budget, SHARES)
    attrs = [*parent_attrs, *child_attrs]
    capped = permute.numbered(child, fk, [F.xxhash64(*child.columns)], cap).select(F.col(fk).alias("_fk"), *child_attrs, "rn")
    rows = capped.join(parent.select(pk, *parent_attrs), F.col(pk) == F.col("_fk"))
    # both tables are read once: all marginals are sums over the combinations that occur (never more than rows)
    cube = saved(rows.groupBy(*attrs).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("rn") == 1).alias("_groups")))
    domain = {r.attr: r.n for r in cube.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("x")) for a in attrs])).alias("c")).groupBy("c.attr").agg(F.count_distinct("c.x").alias("n")).collect()}
    n_pairs = len(attrs) * (len(attrs) - 1) // 2
    noise = privacy.sigma(2 * cap, ledger.charge("scores", budget * SHARES["scores"]), n_pairs)
    scores = [(r.a, r.b, max(0.0, r.s)) for r in marginals.r_scores(marginals.pair_counts(cube, attrs, F.col("_rows").cast("double"))).select("a", "b", (F.col("score") + noise * F.randn(seed)).alias("s")).collect()]
    columns = plan_columns([s for s in scores if s[0] in parent_attrs and s[1] in parent_attrs], {a: domain[a] for a in parent_attrs}, most, limit)
    child_columns = [c for c in plan_columns(scores, domain, most, limit) if c[0] in child_attrs]
    per = ledger.charge("marginals", budget * SHARES["marginals"]) / (len(columns) + len(child_columns))
    # parents: sizes first, then attributes
    h = groups.size_histogram(child, fk, cap)
    h = privacy.noisy_sizes(h, privacy.sigma(1, ledger.charge("sizes", budget * SHARES["sizes"])))
    counts = h.select(F.col("size").alias("size"), F.greatest(F.round("v"), F.lit(0.0)).cast("long").alias("n"))
    parents = sampling.expand(counts, "n").select(F.concat_ws("-", "size", "copy").alias(pk), "size")
    for k, (a, given) in enumerate(columns):
        parents = saved(_fill(parents, pk, given, _measured(cube, "_groups", [*given, a], 1, per, limit, seed + 10 + k), a, domain[a]))
    slot = F.explode(F.sequence(F.lit(1).cast("long"), "size")).alias("_slot")
    children = parents.select(pk, *parent_attrs, slot).withColumn("_key", F.concat_ws("/", pk, "_slot")).drop(pk, "_slot")
    for k, (a, given) in enumerate(child_columns):
        given = [g for g in given if g in children.columns]
        children = _fill(children, "_key", given, _measured(cube, "_rows", [*given, a], cap, per, limit, seed + 100 + k), a, domain[a])
    return parents.select(pk, *parent_attrs), children.select(F.col("_key").alias("child_key"), *child_attrs, F.substring_index("_key", "/", 1).alias(fk))


def _fill(rows: DataFrame, key: str, given: list[str], weights: DataFrame, value: str, values: int) -> DataFrame:
    if given:
        return sampling.conditional_fill(rows, given, key, weights, value)
    # one context: drawn by each row's own hash, without a window over all rows
    w = weights.select(F.lit(1).alias("_one"), value, (F.round(F.col("v") * 1000) + 1).cast("long").alias("n"))
    return sampling.inverse_cdf(rows.withColumn("_one", F.lit(1)), ["_one"], F.concat_ws("#", F.lit(value), key), w, value, values + 1).drop("_one")


@query()
def synth_orders_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Distances by attribute between the real lineitems of orders and synthetic ones."""
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem")
    _, children = synthesise(o, "o_orderkey", ["o_orderstatus", "o_orderpriority"], li, "l_orderkey", ["l_returnflag", "l_linestatus"], 0.421, 7)
    return marginals.attr_tvd(li, children, ["l_returnflag", "l_linestatus"])
