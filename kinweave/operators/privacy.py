"""Budgets of the analytic Gaussian mechanism, noise on cells, and a ledger of what was spent."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.columns import md5_gauss
from kinweave.operators import marginals


def _log_phi(x: float) -> float:
    """log of the standard normal distribution function, also far out on the left."""
    if x > -10:
        return math.log(0.5 * math.erfc(-x / math.sqrt(2)))
    return -x * x / 2 - math.log(-x) - 0.5 * math.log(2 * math.pi) + math.log1p(-1 / (x * x) + 3 / x**4)


def delta_of(budget: float, epsilon: float) -> float:
    """delta of a Gaussian mechanism whose squared sensitivity over variance sums to `budget`."""
    r = math.sqrt(budget)
    return math.exp(_log_phi(r / 2 - epsilon / r)) - math.exp(epsilon + _log_phi(-r / 2 - epsilon / r))


def privacy_budget(epsilon: float, delta: float, tolerance: float = 1e-10) -> float:
    """The budget in [0, epsilon] at which delta_of() is delta, by bisection (Balle and Wang, 2018)."""
    low, high = 1e-12, epsilon
    while high - low > tolerance:
        mid = (low + high) / 2
        if delta_of(mid, epsilon) > delta:
            high = mid
        else:
            low = mid
    return (low + high) / 2


def sigma(sensitivity: float, budget: float, queries: int = 1) -> float:
    return math.sqrt(sensitivity**2 * queries / budget)


def domain_limit(rows: float, noise: float, theta: float, most: float = 5e4) -> float:
    """The most cells a marginal may have so that its expected noise is 1 / theta of its rows."""
    return min(most, rows / (noise * math.sqrt(2 / math.pi)) / theta)


def theoretic_loss(cells: int, noise: float) -> float:
    return cells * noise**2


class Ledger:
    """Budgets by name; a charge that exceeds its share raises. Sensitivities grow with the group
    caps of the keys between a row and the table that is protected."""

    def __init__(self, total: float, shares: dict[str, float]):
        if sum(shares.values()) > 1 + 1e-9:
            raise ValueError("shares exceed the budget")
        self.left = {k: total * s for k, s in shares.items()}

    def charge(self, name: str, amount: float) -> float:
        if amount > self.left[name] * (1 + 1e-9):
            raise ValueError(f"{name} has {self.left[name]} left, {amount} asked for")
        self.left[name] -= amount
        return amount


def sensitivity(caps: list[int], base: float = 1.0) -> float:
    for c in caps:
        base *= c
    return base


def noisy(m: DataFrame, noise: float, seed_key: Column | None = None, seed: int | None = None) -> DataFrame:
    """v plus Gaussian noise in every cell; m has to hold the empty cells too (see densify). With
    seed_key the noise is reproducible, for tests only."""
    z = md5_gauss(seed_key) if seed_key is not None else F.randn(seed)
    return m.withColumn("v", F.col("v") + F.lit(noise) * z)


def noisy_sizes(histogram: DataFrame, noise: float, seed_key: Column | None = None) -> DataFrame:
    """A noisy histogram of group sizes: negative counts become half the noise, size 0 becomes 0."""
    h = noisy(histogram.withColumn("v", F.col("n_groups").cast("double")), noise, seed_key)
    return h.select("size", F.when(F.col("size") == 0, 0.0).when(F.col("v") < 0, 0.5 * noise).otherwise(F.col("v")).alias("v"))


def measured_by_size(m: DataFrame, attrs: list[str], low: int, histogram: DataFrame, noise: float, bias_noise: float, key: Column | None = None) -> tuple[DataFrame, bool]:
    """(a noisy marginal (size, attrs, v), whether sizes from `low` on were merged for it).

    m holds all cells of (size, attrs). Merging makes fewer cells noisy but deals a bin's cells out to its sizes
    in proportion to the noisy histogram (size, n_groups), which is off by the bias. The bias is measured with
    noise of its own, so the choice tells no more than it; then only the chosen table is measured. Negative
    cells become 0, and each size's cells are scaled to its groups. `key` gives reproducible noise, for tests."""
    merged = marginals.merge_sizes(m, attrs, low)
    z = md5_gauss(F.lit("bias")) if key is not None else F.randn()
    tvd = marginals.tvd(m, marginals.unmerge_sizes(merged, attrs, low, histogram), ["size", *attrs])
    bias = tvd.select((F.col("distance") + F.lit(bias_noise) * z).alias("b")).first().b
    merge = merge_pays(m.count(), merged.count(), noise, bias)
    got = noisy(merged if merge else m, noise, key).withColumn("v", F.greatest("v", F.lit(0.0)))
    back = marginals.unmerge_sizes(got, attrs, low, histogram) if merge else got
    return marginals.normalise_by_size(back, histogram), merge


def merge_pays(cells: int, merged_cells: int, noise: float, bias: float) -> bool:
    """Whether merging sizes lowers the expected error; `bias` has to be a noisy or public figure."""
    per = noise * math.sqrt(2 / math.pi)
    return per * merged_cells + 2 * bias < per * cells
