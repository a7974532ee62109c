"""Which attributes go together. Scores come from Spark; the graph over attributes is tiny (one node
per attribute, whatever the number of rows), so it is a dict of sets on the driver."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Graph = dict[str, set[str]]


def graph_of(nodes: list[str], edges: list[tuple[str, str]]) -> Graph:
    g: Graph = {n: set() for n in nodes}
    for a, b in edges:
        g[a].add(b)
        g[b].add(a)
    return g


def triangulated(g: Graph) -> Graph:
    """Chordal completion: nodes go in ascending degree of the given graph, and a node's remaining
    neighbours become neighbours of each other."""
    out, left = {n: set(s) for n, s in g.items()}, {n: set(s) for n, s in g.items()}
    for n in sorted(g, key=lambda x: (len(g[x]), x)):
        for a, b in combinations(sorted(left[n]), 2):
            for h in (out, left):
                h[a].add(b)
                h[b].add(a)
        for m in left.pop(n):
            left[m].discard(n)
    return out


def maximal_cliques(g: Graph) -> list[frozenset[str]]:
    """All maximal cliques, by Bron and Kerbosch with a pivot."""
    found: list[frozenset[str]] = []

    def grow(r: set[str], p: set[str], x: set[str]) -> None:
        if not p and not x:
            found.append(frozenset(r))
            return
        pivot = max(sorted(p | x), key=lambda n: len(g[n] & p))
        for n in sorted(p - g[pivot]):
            grow(r | {n}, p & g[n], x & g[n])
            p.remove(n)
            x.add(n)

    grow(set(), set(g), set())
    return sorted(found, key=sorted)


def junction_tree(cliques: list[frozenset[str]]) -> list[tuple[int, int]]:
    """Edges of a spanning tree of the cliques with the largest separators."""
    inside, edges = {0}, []
    while len(inside) < len(cliques):
        a, b = max(((a, b) for a in inside for b in range(len(cliques)) if b not in inside), key=lambda e: (len(cliques[e[0]] & cliques[e[1]]), -e[0], -e[1]))
        edges.append((a, b))
        inside.add(b)
    return edges


def cells(attrs, domain: dict[str, int]) -> int:
    return math.prod(domain[a] for a in attrs)


def grow_graph(domain: dict[str, int], scores: list[tuple[str, str, float]], clique_limit: float, total_limit: float) -> Graph:
    """Edges by falling score, each kept if the triangulated graph stays within both limits."""
    edges: list[tuple[str, str]] = []
    for a, b, _ in sorted(scores, key=lambda e: (-e[2], e[0], e[1])):
        sizes = [cells(c, domain) for c in maximal_cliques(triangulated(graph_of(list(domain), [*edges, (a, b)])))]
        if max(sizes) <= clique_limit and sum(sizes) <= total_limit:
            edges.append((a, b))
    return triangulated(graph_of(list(domain), edges))


def candidates(cliques: list[frozenset[str]], domain: dict[str, int], most_attrs: int, limit: float, maximal: bool = True) -> list[tuple[str, ...]]:
    """Attribute sets within a clique, of few attributes and cells; with `maximal`, only those that no
    other one contains."""
    found = {s for c in cliques for k in range(1, most_attrs + 1) for s in combinations(sorted(c), k) if cells(s, domain) <= limit}
    if maximal:
        found = {s for s in found if not any(set(s) < set(t) for t in found)}
    return sorted(found)


def cfs_score(target: str, others: list[str], score: dict[frozenset[str], float]) -> float:
    """Correlation-based feature score of a set of attributes for a target."""
    get = lambda a, b: score.get(frozenset((a, b)), 0.0)
    gain = max(sum(get(a, target) for a in others), 0.0)
    return gain / math.sqrt(max(2 * (len(others) + sum(get(a, b) for a, b in combinations(others, 2))), 1.0))


def best_set(target: str, found: list[tuple[str, ...]], score: dict[frozenset[str], float]) -> tuple[str, ...] | None:
    """The candidate that holds target and whose other attributes score best for it."""
    return max((s for s in found if target in s), key=lambda s: (cfs_score(target, [a for a in s if a != target], score), s), default=None)


def next_attr(left: list[str], done: list[str], score: dict[frozenset[str], float], domain: dict[str, int]) -> str:
    return max(left, key=lambda t: (sum(score.get(frozenset((t, a)), 0.0) for a in done) / math.sqrt(domain[t]), t))


def schedule(n: int, rounds: int) -> list[int]:
    """n queries over at most so many rounds, as evenly as can be."""
    k = max(1, min(n, rounds))
    return [n // k + (i < n % k) for i in range(k)] if n else []


def cfs_scores(edges: DataFrame, target: str, sets: dict[str, list[str]]) -> DataFrame:
    """(set_name, score) of several attribute sets for a target, from a table of scores (a, b,
    score)."""
    one = edges.agg(*[_cfs(edges, target, others).alias(name) for name, others in sets.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("set_name"), F.col(n).alias("score")) for n in sets])).alias("x")).select("x.*")


def _cfs(edges: DataFrame, target: str, others: list[str]) -> Column:
    a, b, s = F.col("a"), F.col("b"), F.col("score")
    to_target = ((a == target) & b.isin(others)) | ((b == target) & a.isin(others))
    gain = F.greatest(F.sum(F.when(to_target, s).otherwise(0.0)), F.lit(0.0))
    inner = F.sum(F.when(a.isin(others) & b.isin(others), s).otherwise(0.0))
    return gain / F.sqrt(F.greatest(2 * (F.lit(len(others)) + inner), F.lit(1.0)))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    return edges.orderBy(F.desc("score"), "a", "b").limit(k)
