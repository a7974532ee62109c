"""Fitting a model to overlapping marginals over a junction tree, and choosing which marginals to measure.

The model is one table per clique of a triangulated graph, as long tables (attributes, v). All tables agree on
what they share; the joint table is never made. Fitting a marginal scales the table of a clique that holds
it. A neighbour then takes the news over by being scaled to the shared attributes' new sums, which is the same
operation: a message is a proportional fit to a separator. So a step touches one table of bounded cells, and
is written, which keeps plans short however many rounds there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.columns import md5_gauss
from kinweave.operators import marginals, structure
from kinweave.operators.draws import random_order
from kinweave.sources.scratch import saved

Set = tuple[str, ...]


def graph_over(attrs: list[str], sets: list[Set]) -> structure.Graph:
    """The triangulated graph in which each set is connected."""
    return structure.triangulated(structure.graph_of(attrs, [e for s in sets for e in combinations(sorted(s), 2)]))


class JunctionTree:
    """Clique tables over `domain` (attribute -> values), at first uniform with sum `total`."""

    def __init__(self, like: DataFrame, domain: dict[str, list], sets: list[Set], total: float, limit: int = 1_000_000):
        self.total = total
        self.cliques = structure.maximal_cliques(graph_over(list(domain), sets))
        self.near: dict[int, list[int]] = {k: [] for k in range(len(self.cliques))}
        for a, b in structure.junction_tree(self.cliques):
            self.near[a].append(b)
            self.near[b].append(a)
        self.tables = []
        for c in self.cliques:
            empty = like.select(*sorted(c), F.lit(0.0).alias("v")).limit(0)
            grid = marginals.filled(empty, {a: domain[a] for a in sorted(c)}, limit)
            self.tables.append(saved(grid.withColumn("v", F.lit(total / structure.cells(c, {a: len(x) for a, x in domain.items()})))))
        self.at = 0  # the clique that has all news

    def home(self, attrs: Set) -> int:
        """The first clique that holds all attrs."""
        for k, c in enumerate(self.cliques):
            if c >= set(attrs):
                return k
        raise ValueError(f"no clique holds {attrs}")

    def path(self, a: int, b: int) -> list[int]:
        """Cliques from a to b, both included."""
        before: dict[int, int] = {a: a}
        left = [a]
        for k in left:
            left += [n for n in self.near[k] if n not in before]
            before |= {n: k for n in self.near[k] if n not in before}
        out = [b]
        while out[-1] != a:
            out.append(before[out[-1]])
        return out[::-1]

    def _scale(self, k: int, attrs: list[str], totals: DataFrame) -> None:
        self.tables[k] = saved(marginals.scale_along(self.tables[k], attrs, totals).select(*sorted(self.cliques[k]), "v"))

    def _absorb(self, source: int, k: int) -> None:
        shared = sorted(self.cliques[source] & self.cliques[k])
        if shared:  # parts of the graph without a common attribute have nothing to tell each other
            self._scale(k, shared, marginals.project(self.tables[source], shared))

    def go(self, k: int) -> None:
        """Take the news to clique k."""
        way = self.path(self.at, k)
        for a, b in zip(way, way[1:], strict=False):
            self._absorb(a, b)
        self.at = k

    def spread(self) -> None:
        """Take the news everywhere: all tables agree."""
        seen, left = {self.at}, [self.at]
        for k in left:
            for n in self.near[k]:
                if n not in seen:
                    self._absorb(k, n)
                    seen.add(n)
                    left.append(n)

    def fit(self, targets: dict[Set, DataFrame], rounds: int) -> None:
        """Proportional fitting to marginals (attrs, v), in the order of their cliques; each is scaled to the
        model's total first, so that noisy ones don't pull it up and down."""
        even = {}
        for s, t in targets.items():
            mass = t.agg(F.sum("v")).first()[0] or 0.0
            even[s] = saved(t.select(*s, (F.col("v") * F.lit(self.total / mass if mass > 0 else 0.0)).alias("v")))
        for _ in range(rounds):
            for s in sorted(even, key=lambda s: (self.home(s), s)):
                self.go(self.home(s))
                self._scale(self.at, list(s), even[s])
        self.spread()

    def marginal(self, attrs: Set) -> DataFrame:
        """(attrs, v) of a set within a clique, after `fit` or `spread`."""
        return marginals.project(self.tables[self.home(attrs)], list(attrs))

    def cells(self, sets: list[Set]) -> DataFrame:
        """(marginal, cell, v) of several sets."""
        out = None
        for k in sorted({self.home(s) for s in sets}):
            one = marginals.cell_counts(self.tables[k], [s for s in sets if self.home(s) == k], F.col("v"))
            out = one if out is None else out.unionByName(one)
        return out


def model_errors(df: DataFrame, tree: JunctionTree, sets: list[Set]) -> DataFrame:
    """(marginal, error): half the sum of differences between data and model, one pass over the data for all
    sets."""
    x = marginals.cell_counts(df, sets).withColumnRenamed("v", "x")
    y = tree.cells(sets).withColumnRenamed("v", "y")
    diff = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return x.join(y, ["marginal", "cell"], "full").groupBy("marginal").agg((F.sum(diff) / 2).alias("error"))


@dataclass(frozen=True)
class Chosen:
    round: int
    marginal: Set
    error: float
    chosen: bool


def _noise(key: Column, seed: int | None) -> Column:
    return F.randn() if seed is None else F.round(md5_gauss(F.concat_ws("#", F.lit(str(seed)), key)), 6)


def select_marginals(df: DataFrame, tree: JunctionTree, measured: dict[Set, DataFrame], candidates: list[Set], counts: list[int], error_noise: float, cell_noise: float, seed: int | None, fit_rounds: int = 10, most: int = 400, enough: float = 0.01) -> list[Chosen]:
    """Marginals chosen round by round: of at most `most` random candidates those whose noisy error under the
    model is largest, counts[r] in round r; they are measured with noise and the model is fitted again. It
    stops when the largest error is below `enough`. `measured` (fitted already) and `tree` go along.

    Errors and marginals have sensitivities and budgets of their own; the two noises are given. Nothing exact is
    kept: what is returned is noisy. The driver handles names and one error per candidate."""
    left, out = list(candidates), []
    for r, n in enumerate(counts):
        asked = random_order(left, (seed or 0) + r)[:most]
        if not asked:
            break
        noisy = model_errors(df, tree, asked).withColumn("error", F.col("error") + F.lit(error_noise) * _noise(F.concat_ws("#", F.lit(f"round {r}"), "marginal"), seed))
        errors = {tuple(x.marginal.split(",")): x.error for x in noisy.collect()}
        order = sorted(errors, key=lambda s: (-errors[s], s))
        out += [Chosen(r, s, errors[s], k < n) for k, s in enumerate(order)]
        for s in order[:n]:
            m = marginals.filled(marginals.marginal(df, list(s)), {a: tree_values(tree, a) for a in s})
            z = _noise(F.concat_ws("|", F.lit(",".join(s)), *s), seed)
            measured[s] = saved(m.withColumn("v", F.greatest(F.col("v") + F.lit(cell_noise) * z, F.lit(0.0))))
            left.remove(s)
        tree.fit(measured, fit_rounds)
        if not order or errors[order[0]] < enough:
            break
    return out


def tree_values(tree: JunctionTree, attr: str) -> list:
    """The attribute's domain: its column of a bounded clique table."""
    return sorted(r[0] for r in tree.tables[tree.home((attr,))].select(attr).distinct().collect())
