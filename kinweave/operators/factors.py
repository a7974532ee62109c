"""Factors as long tables (attributes, v), and inference over a tree of them as joins and sums."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import marginals


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c != "v" and c in b.columns]


def combine(a: DataFrame, b: DataFrame, how: str = "*") -> DataFrame:
    """Natural join on the attributes both have; values multiplied, added, subtracted or divided (0
    for a division by 0). Factors have to share an attribute."""
    on = _shared(a, b)
    if not on:
        raise ValueError("factors share no attribute")
    x, y = F.col("v"), F.col("_w")
    v = {"*": x * y, "+": x + y, "-": x - y, "/": F.when(y != 0, x / y).otherwise(0.0)}[how]
    return a.join(b.withColumnRenamed("v", "_w"), on).withColumn("v", v).drop("_w")


def product(factors: list[DataFrame]) -> DataFrame:
    return reduce(combine, factors)


def condition(f: DataFrame, **values) -> DataFrame:
    """The slice at the given values, without those attributes."""
    for a, x in values.items():
        f = f.filter(F.col(a) == F.lit(x))
    return f.drop(*values)


def sum_out(f: DataFrame, keep: list[str]) -> DataFrame:
    return f.groupBy(*keep).agg(F.sum("v").alias("v"))


def logsumexp(f: DataFrame, keep: list[str]) -> DataFrame:
    """log of the sum of exp(v) by `keep`, shifted by the largest v."""
    top = F.max("v").over(Window.partitionBy(*keep))
    g = f.withColumn("_m", top)
    return g.groupBy(*keep).agg((F.max("_m") + F.log(F.sum(F.exp(F.col("v") - F.col("_m"))))).alias("v"))


def squared_loss(p: DataFrame, q: DataFrame) -> DataFrame:
    """Half the squared distance of two factors over the same cells."""
    on = _shared(p, q)
    d = F.coalesce(p["v"], F.lit(0.0)) - F.coalesce(q["v"], F.lit(0.0))
    return p.join(q, on, "full").agg((F.sum(d * d) / 2).alias("loss"))


def tree_marginals(cliques: dict[str, DataFrame], edges: list[tuple[str, str]]) -> dict[str, DataFrame]:
    """Belief propagation on a tree of cliques: unnormalised marginals of every clique.

    A message is the sender's potential times what its other neighbours sent, summed down to the
    attributes it shares with the receiver. Each is one join and one aggregation; there are two per
    edge, and both ends' cliques have to share attributes."""
    near: dict[str, list[str]] = {c: [] for c in cliques}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    sent: dict[tuple[str, str], DataFrame] = {}

    def message(a: str, b: str) -> DataFrame:
        if (a, b) not in sent:
            inner = product([cliques[a], *[message(c, a) for c in near[a] if c != b]])
            sent[a, b] = sum_out(inner, _shared(cliques[a], cliques[b]))
        return sent[a, b]

    return {c: product([cliques[c], *[message(n, c) for n in near[c]]]) for c in cliques}


def normalised(f: DataFrame) -> DataFrame:
    """v divided by the sum over the factor; a factor has a bounded number of cells."""
    return f.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy()))


# ---- factors that know their domain ------------------------------------------------------------


@dataclass(frozen=True)
class Factor:
    """A function over a domain (attribute -> values): the cells at hand (attributes, v), and `absent` for all
    others. Arithmetic is by cell over the union of two domains, which have to agree on what they share; the
    number of cells is checked against `limit` before a table over a whole domain is made."""

    cells: DataFrame
    domain: dict[str, list]
    absent: float = 0.0
    limit: int = 1_000_000

    @staticmethod
    def full(like: DataFrame, domain: dict[str, list], value: float = 0.0) -> Factor:
        """The same value everywhere; `like` has the attributes' types."""
        return Factor(like.select(*domain, F.lit(0.0).alias("v")).limit(0), domain, value)

    def dense(self) -> DataFrame:
        return marginals.filled(self.cells, self.domain, self.limit, self.absent)

    def _union(self, other: Factor) -> dict[str, list]:
        for a in self.domain.keys() & other.domain.keys():
            if self.domain[a] != other.domain[a]:
                raise ValueError(f"the domains of {a} differ")
        return self.domain | other.domain

    def _each(self, f) -> Factor:
        one = self.cells.limit(0).select(F.lit(1)).sparkSession.range(1).select(f(F.lit(float(self.absent))).cast("double").alias("v")).first().v
        return Factor(self.cells.withColumn("v", f(F.col("v")).cast("double")), self.domain, one, self.limit)

    def _with(self, other: Factor | float, f) -> Factor:
        if not isinstance(other, Factor):
            return self._each(lambda v: f(v, F.lit(float(other))))
        domain = self._union(other)
        grid = marginals.filled(self.cells, self.domain | {}, self.limit, self.absent) if domain == self.domain else _grown(self, domain)
        shared = [a for a in other.domain]
        right = other.cells.select(*[F.col(a).alias(f"_{a}") for a in shared], F.col("v").alias("_w"))
        on = reduce(lambda p, q: p & q, [F.col(a).eqNullSafe(F.col(f"_{a}")) for a in shared], F.lit(True))
        both = grid.join(right, on, "left").withColumn("_w", F.coalesce("_w", F.lit(float(other.absent))))
        return Factor(both.select(*domain, f(F.col("v"), F.col("_w")).cast("double").alias("v")), domain, 0.0, self.limit)

    def __add__(self, other: Factor | float) -> Factor:
        return self._with(other, lambda x, y: x + y)

    def __sub__(self, other: Factor | float) -> Factor:
        return self._with(other, lambda x, y: x - y)

    def __mul__(self, other: Factor | float) -> Factor:
        if isinstance(other, Factor) and self.absent == other.absent == 0 and self.domain.keys() & other.domain.keys():
            return Factor(combine(self.cells, other.cells), self._union(other), 0.0, self.limit)  # absent cells stay absent
        return self._with(other, lambda x, y: x * y)

    def __truediv__(self, other: Factor | float) -> Factor:
        """0 for a division by 0."""
        return self._with(other, lambda x, y: F.when(y != 0, x / y).otherwise(0.0))

    def exp(self) -> Factor:
        return self._each(F.exp)

    def log(self) -> Factor:
        """Minus infinity for what isn't positive, so that exp gives 0 again."""
        return self._each(lambda v: F.when(v > 0, F.log(v)).otherwise(F.lit(float("-inf"))))

    def sum_out(self, keep: list[str]) -> Factor:
        cells = self.cells if self.absent == 0 else self.dense()
        return Factor(sum_out(cells, keep), {a: self.domain[a] for a in keep}, 0.0, self.limit)

    def logsumexp(self, keep: list[str]) -> Factor:
        cells = self.cells.filter(F.col("v") > float("-inf")) if self.absent == float("-inf") else self.dense()
        return Factor(logsumexp(cells, keep), {a: self.domain[a] for a in keep}, float("-inf"), self.limit)

    def condition(self, **values) -> Factor:
        return Factor(condition(self.cells, **values), {a: x for a, x in self.domain.items() if a not in values}, self.absent, self.limit)

    def loss(self, other: Factor) -> DataFrame:
        """Half the squared distance, one row."""
        d = (self - other).dense()
        return d.agg((F.sum(F.col("v") * F.col("v")) / 2).alias("loss"))

    def dot(self, other: Factor) -> DataFrame:
        """The inner product, one row."""
        return (self * other).dense().agg(F.sum("v").alias("dot"))


def _grown(f: Factor, domain: dict[str, list]) -> DataFrame:
    """f's values over a larger domain."""
    kinds = {a: x for a, x in domain.items() if a not in f.domain}
    if not f.domain:
        base = f.cells
    else:
        base = f.dense()
    size = reduce(lambda n, x: n * len(x), domain.values(), 1)
    if size > f.limit:
        raise ValueError(f"{size} cells are more than {f.limit}")
    for a, values in kinds.items():
        base = base.withColumn(a, F.explode(F.array(*map(F.lit, values))))
    return base
