"""Groups whose members depend on each other: a group is drawn slot by slot, each column of a member given the
parent's, its own earlier columns and those of earlier members.

Members of a group are exchangeable, so a marginal over any two or three slots is one over the first two or
three of a random permutation. A column of slot t is drawn in groups of more than t members only. Groups
are brought together once and counted by kind (the parent's values and the multiset of the members'); members of
kinds are permuted, not those of groups. The measured tables are bounded by a limit of cells; rows of groups meet them
in broadcast joins and are never shuffled, so drawing is one pass over the new groups, whatever the number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.columns import md5_gauss, md5_int
from kinweave.operators import groups, marginals, permute, privacy, sampling, structure
from kinweave.operators.ordered import number_within
from kinweave.sources.scratch import saved

SHARES = {"scores": 0.1, "sizes": 0.1, "marginals": 0.8}


@dataclass(frozen=True)
class Draw:
    """A column of a group's row, a parent's attribute or m{slot}_{attribute}, and what it is drawn from
    besides the group's size."""

    target: str
    given: tuple[str, ...]

    @property
    def slot(self) -> int:
        return slot_of(self.target)


def slot_of(column: str) -> int:
    """The member a column belongs to; -1 for the parent."""
    head = column.split("_", 1)[0]
    return int(head[1:]) if head[:1] == "m" and head[1:].isdigit() else -1


def attr_of(column: str) -> str:
    return column.split("_", 1)[1] if slot_of(column) >= 0 else column


def canonical(columns: list[str]) -> dict[str, str]:
    """Each column's name when the slots among them are numbered 0, 1, 2 in order."""
    slots = sorted({slot_of(c) for c in columns} - {-1})
    return {c: c if slot_of(c) < 0 else f"m{slots.index(slot_of(c))}_{attr_of(c)}" for c in columns}


# ---- groups by kind -----------------------------------------------------------------------------


def gathered(members: DataFrame, fk: str, attrs: list[str]) -> DataFrame:
    """(fk, members): one row per group, with the values of its members (rows of groups cut to some size)."""
    return members.groupBy(fk).agg(F.collect_list(F.struct(*attrs)).alias("members"))


def gathered_wide(wide: DataFrame, attrs: list[str], slots: int, keep: list[str]) -> DataFrame:
    """(keep, members): the same of rows (size, m{t}_{attribute}), without a shuffle."""
    cells = F.array(*[F.struct(*[F.col(f"m{t}_{a}").alias(a) for a in attrs]) for t in range(slots)])
    return wide.select(*keep, F.slice(cells, 1, F.least("size", F.lit(slots)).cast("int")).alias("members"))


def kinds(groups: DataFrame, attrs: list[str], parent_attrs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Groups (parent_attrs, members) counted by kind, as members (kind, rn, n, attrs) and parents (kind,
    parent_attrs, groups): marginals over any members' permutations need no more. There are never more kinds than
    groups, and with small domains and sizes there are few."""
    counted = groups.groupBy(*parent_attrs, F.sort_array("members").alias("members")).agg(F.count(F.lit(1)).alias("groups"))
    counted = saved(counted.withColumn("kind", F.monotonically_increasing_id()))
    rows = counted.select("kind", F.size("members").cast("long").alias("n"), F.posexplode("members").alias("rn", "m"))
    return rows.select("kind", (F.col("rn") + 1).alias("rn"), "n", "m.*"), counted.select("kind", *parent_attrs, "groups")


def kinds_of(child: DataFrame, fk: str, attrs: list[str], parent: DataFrame, pk: str, parent_attrs: list[str], order: list[Column], cap: int) -> tuple[DataFrame, DataFrame]:
    """`kinds` of the groups of a child table, of whose members the first `cap` count."""
    members = permute.numbered(child.select(*dict.fromkeys([fk, *attrs]), *[o.alias(f"_o{k}") for k, o in enumerate(order)]), fk, [F.col(f"_o{k}") for k in range(len(order))], cap)
    return kinds(gathered(members, fk, attrs).join(parent.select(F.col(pk).alias(fk), *parent_attrs), fk), attrs, parent_attrs)


# ---- structure ---------------------------------------------------------------------------------


def member_scores(members: DataFrame, fk: str, attrs: list[str], parent: DataFrame, pk: str, parent_attrs: list[str], times: str | None = None) -> DataFrame:
    """(a, b, score) over the parent's attributes and those of two members: m0_* and m1_* stand for any two. A parent
    stands for as many as its column `times` has."""
    two = permute.permutations(members.filter("n > 1"), fk, attrs, 2).join(parent.select(F.col(pk).alias(fk), *parent_attrs, *([times] if times else [])), fk)
    weight = F.col("weight") * F.col(times) if times else F.col("weight")
    return marginals.r_scores(marginals.pair_counts(two, [*parent_attrs, *[f"m{t}_{a}" for t in (0, 1) for a in attrs]], weight))


def score_between(scores: dict[frozenset[str], float], a: str, b: str) -> float:
    """The score of two columns of any slots; both orders of two members count half."""
    if slot_of(a) < 0 and slot_of(b) < 0:
        return scores.get(frozenset((a, b)), 0.0)
    if slot_of(a) < 0 or slot_of(b) < 0 or slot_of(a) == slot_of(b):
        to = lambda c, t: c if slot_of(c) < 0 else f"m{t}_{attr_of(c)}"
        return sum(scores.get(frozenset((to(a, t), to(b, t))), 0.0) for t in (0, 1)) / 2
    return sum(scores.get(frozenset((f"m{s}_{attr_of(a)}", f"m{t}_{attr_of(b)}")), 0.0) for s, t in ((0, 1), (1, 0))) / 2


def conditioning(target: str, done: list[str], scores: dict[frozenset[str], float], domain: dict[str, int], most: int, limit: float, members: int = 2) -> tuple[str, ...]:
    """What a column is drawn from: half of `most` from its own member, the rest from the parent and at most
    `members` earlier members, each by falling score (later slots first among equals), while the table over
    them, the target and the size stays within `limit` cells."""
    rank = lambda cs: sorted(cs, key=lambda c: (-score_between(scores, c, target), -slot_of(c), c))
    own = rank([c for c in done if slot_of(c) == slot_of(target) >= 0])[: most // 2]
    chosen: list[str] = []
    for c in [*own, *rank([c for c in done if slot_of(c) != slot_of(target) or slot_of(target) < 0])]:
        slots = {slot_of(x) for x in [*chosen, c]} - {-1, slot_of(target)}
        if len(chosen) < most and len(slots) <= members and structure.cells([attr_of(x) for x in [*chosen, c, target]], domain) * domain["size"] <= limit:
            chosen.append(c)
    return tuple(chosen)


def plan(scores: dict[frozenset[str], float], parent_attrs: list[str], attrs: list[str], slots: int, domain: dict[str, int], most: int = 4, limit: float = 5_000) -> list[Draw]:
    """Draws of all columns in order: the parent's, then member by member; within each the column goes first
    that what is there says most about, by the square root of its domain."""
    out: list[Draw] = []
    done: list[str] = []
    for columns in ([*parent_attrs], *[[f"m{t}_{a}" for a in attrs] for t in range(slots)]):
        left = list(columns)
        while left:
            target = max(left, key=lambda c: (sum(score_between(scores, c, x) for x in done) / domain[attr_of(c)] ** 0.5, c))
            out.append(Draw(target, conditioning(target, done, scores, domain, most, limit)))
            left.remove(target)
            done.append(target)
    return out


# ---- measuring and drawing ---------------------------------------------------------------------


def gaussian(key: Column, seed: int | None) -> Column:
    """Standard normal noise: fresh without a seed; with one from the key's hash, for tests."""
    return F.randn() if seed is None else F.round(md5_gauss(F.concat_ws("#", F.lit(str(seed)), key)), 6)


def measured(members: DataFrame, parents: DataFrame, draw: Draw, values: dict[str, list], sigma: float, seed: int | None, limit: int) -> DataFrame:
    """The noisy marginal that a draw needs, from `kinds`: (size, given, target, n) over all cells of groups with more
    members than the target's slot; n is a whole number of thousandths, one more than the noisy count, so that every
    cell can be drawn."""
    names = canonical([*draw.given, draw.target])
    slots = len({slot_of(c) for c in names} - {-1})
    some = members.filter(F.col("n") > draw.slot)
    if slots:
        table = permute.permutations(some, "kind", sorted({attr_of(c) for c in names if slot_of(c) >= 0}), slots)
    else:
        table = some.filter("rn = 1").select("kind", "n").withColumn("weight", F.lit(1.0))
    flat = table.join(parents.select("kind", "groups", *[c for c in names if slot_of(c) < 0]), "kind")
    m = flat.groupBy(F.col("n").alias("size"), *[F.col(names[c]).alias(c) for c in names]).agg(F.sum(F.col("weight") * F.col("groups")).alias("v"))
    axes = {"size": [n for n in values["size"] if n > draw.slot]} | {c: values[attr_of(c)] for c in names}
    dense = marginals.filled(m, axes, limit)
    z = gaussian(F.concat_ws("|", F.lit(draw.target), "size", *names), seed)
    n = F.floor((F.round("v", 6) + F.lit(sigma) * z) * 1000 + 0.5)
    return dense.select("size", *names, (F.greatest(n, F.lit(0)) + 1).cast("long").alias("n"))


def new_groups(child: DataFrame, fk: str, cap: int, sigma: float, seed: int | None) -> DataFrame:
    """(group, size): as many groups of each size as the noisy histogram has."""
    h = groups.size_histogram(child, fk, cap)
    n = F.floor(F.col("n_groups") + F.lit(sigma) * gaussian(F.concat_ws("|", F.lit("size"), "size"), seed) + 0.5)
    counts = h.select("size", F.greatest(n, F.lit(0)).cast("long").alias("n"))
    return sampling.expand(counts, "n").select(F.concat_ws("-", "size", "copy").alias("group"), "size")


def draw_groups(fresh: DataFrame, draws: list[Draw], tables: dict[str, DataFrame], domain: dict[str, int]) -> DataFrame:
    """fresh (group, size) with all columns drawn, null in slots beyond the size."""
    for d in draws:
        fresh = sampling.inverse_cdf(fresh, ["size", *d.given], F.concat_ws("#", F.lit(d.target), "group"), tables[d.target], d.target, domain[attr_of(d.target)])
    return fresh


def synthesise(child: DataFrame, fk: str, attrs: list[str], parent: DataFrame, pk: str, parent_attrs: list[str], values: dict[str, list], order: list[Column], cap: int, budget: float, draws: list[Draw] | None = None, most: int = 4, limit: int = 5_000, seed: int | None = None, counted: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, list[Draw]]:
    """New groups in one row each (group, size, the parent's attributes, m{t}_{attribute}), and the draws.

    `values` are the attributes' public domains (rows with other values don't count). Sizes, scores and
    marginals are measured under one budget; a parent row with its group counts once. Without `draws` they
    are planned from noisy scores. `counted`: the child's `kinds_of`, where they are at hand."""
    ledger = privacy.Ledger(budget, SHARES)
    domain = {a: len(x) for a, x in values.items()} | {"size": cap}
    values = values | {"size": list(range(1, cap + 1))}
    members, parents = counted or kinds_of(child, fk, attrs, parent, pk, parent_attrs, order, cap)
    if draws is None:
        scores = member_scores(members, "kind", attrs, parents, "kind", parent_attrs, "groups")
        columns = len(parent_attrs) + 2 * len(attrs)
        noise = privacy.sigma(2, ledger.charge("scores", budget * SHARES["scores"]), columns * (columns - 1) // 2)
        noisy = scores.withColumn("score", F.col("score") + F.lit(noise) * gaussian(F.concat_ws("|", "a", "b"), seed))
        draws = plan({frozenset((r.a, r.b)): max(0.0, r.score) for r in noisy.collect()}, parent_attrs, attrs, cap, domain, most, limit)
    per = ledger.charge("marginals", budget * SHARES["marginals"]) / len(draws)
    tables = {d.target: saved(measured(members, parents, d, values, privacy.sigma(1, per), seed, limit)) for d in draws}
    fresh = new_groups(child, fk, cap, privacy.sigma(1, ledger.charge("sizes", budget * SHARES["sizes"])), seed)
    return draw_groups(fresh, draws, tables, domain), draws


def member_rows(wide: DataFrame, attrs: list[str], slots: int, parent_attrs: tuple[str, ...] = ()) -> DataFrame:
    """(group, rn, n, the parent's attributes and the members') of the members that groups have."""
    rows = gathered_wide(wide, attrs, slots, ["group", "size", *parent_attrs]).select("group", F.col("size").alias("n"), *parent_attrs, F.posexplode("members").alias("rn", "m"))
    return rows.select("group", (F.col("rn") + 1).alias("rn"), "n", *parent_attrs, "m.*")


def pair_shares(members: DataFrame, fk: str, attr: str) -> DataFrame:
    """(m0_, m1_, v): shares of value pairs over ordered pairs of members (fk, rn, n), each group of two or more
    counting once."""
    return _pair_shares(gathered(members.filter("n > 1"), fk, [attr]), attr)


def wide_pair_shares(wide: DataFrame, attr: str, slots: int) -> DataFrame:
    """The same of rows (size, m{t}_{attribute}), one per group."""
    return _pair_shares(gathered_wide(wide.filter("size > 1"), [attr], slots, []), attr)


def _pair_shares(groups: DataFrame, attr: str) -> DataFrame:
    members, parents = kinds(groups, [attr], [])
    pairs = permute.permutations(members, "kind", [attr], 2).join(parents, "kind")
    m = pairs.groupBy(f"m0_{attr}", f"m1_{attr}").agg(F.sum(F.col("weight") * F.col("groups")).alias("v"))
    return m.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy()))  # as many rows as value pairs


def keyed_tables(wide: DataFrame, parent_attrs: list[str], attrs: list[str], slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(parents: key and attributes; children: child_key, attributes, key) with numbers from 0 as keys, in a
    random order that tells nothing of how groups were drawn."""
    numbered = number_within(wide, [], [md5_int(F.concat_ws("#", F.lit(str(seed)), "group")), F.col("group")], "key")
    children = groups.recover(numbered, "key", attrs, slots)
    return numbered.select("key", *parent_attrs), number_within(children, [], [F.col("key"), F.col("slot")], "child_key").select("child_key", *attrs, "key")
