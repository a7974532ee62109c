"""Names of marginals over groups: slots, permutations of members, flattened domains, projections.

Attributes of the k-th member are called mk_name. What is handled here are names, whose number is
bounded by the model; tables are only renamed or aggregated.
"""

from __future__ import annotations

import re
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.structure import cells

_MEMBER = re.compile(r"m(\d+)_(.+)", re.DOTALL)


def members_of(attrs) -> tuple[list[str], dict[int, tuple[str, ...]]]:
    """The parent's attributes, and by slot the sorted names of its member's."""
    parent, slots = [], {}
    for a in attrs:
        m = _MEMBER.fullmatch(a)
        if m:
            slots.setdefault(int(m[1]), []).append(m[2])
        else:
            parent.append(a)
    return parent, {s: tuple(sorted(names)) for s, names in sorted(slots.items())}


def _renamed(slots: dict[int, tuple[str, ...]], to: dict[int, int]) -> dict[str, str]:
    return {f"m{s}_{a}": f"m{to[s]}_{a}" for s, names in slots.items() for a in names}


def canonical(attrs) -> dict[str, str]:
    """A renaming of member attributes under which marginals that differ only in their slots get the same
    names: members are sorted by what they hold and numbered from 0."""
    _, slots = members_of(attrs)
    order = sorted(slots, key=lambda s: (slots[s], s))
    return _renamed(slots, {s: k for k, s in enumerate(order)})


def placements(attrs, k: int) -> list[dict[str, str]]:
    """All renamings that put the members of a permutation marginal into distinct ones of k slots."""
    _, slots = members_of(attrs)
    return [_renamed(slots, dict(zip(slots, p, strict=True))) for p in permutations(range(k), len(slots))]


def reorderings(attrs) -> list[dict[str, str]]:
    """All renamings that exchange the members among their own slots: the same distribution each."""
    _, slots = members_of(attrs)
    return [_renamed(slots, dict(zip(slots, p, strict=True))) for p in permutations(slots)]


def flattened_domain(parent: dict[str, int], member: dict[str, int], k: int) -> dict[str, int]:
    """The parent's domain and k copies of the member's."""
    return parent | {f"m{s}_{a}": n for s in range(k) for a, n in member.items()}


def placed(measured, k: int, cliques: list[frozenset[str]]) -> list[tuple[str, ...]]:
    """Where a measured permutation marginal can be learned from: its placements within a clique."""
    parent, _ = members_of(measured)
    found = {tuple(sorted([*parent, *p.values()])) for p in placements(measured, k)}
    return sorted(s for s in found if any(set(s) <= c for c in cliques))


def lattice(measured: list[tuple[str, ...]], domain: dict[str, int], most: int) -> dict[tuple[str, ...], tuple[str, ...]]:
    """{attribute set: the measured marginal with the fewest cells that holds it}, for all sets of at
    most so many attributes that some marginal holds."""
    out: dict[tuple[str, ...], tuple[str, ...]] = {}
    for m in sorted(measured, key=lambda m: (cells(m, domain), m)):
        for k in range(1, min(most, len(m)) + 1):
            for s in combinations(sorted(m), k):
                out.setdefault(s, m)
    return dict(sorted(out.items()))


def project(m: DataFrame, attrs) -> DataFrame:
    """The marginal of fewer attributes, from one that holds them: nothing is read again."""
    return m.groupBy(*attrs).agg(F.sum("v").alias("v"))
