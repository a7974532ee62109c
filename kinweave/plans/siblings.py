"""Queries over groups whose members depend on each other: scores between members, synthesis slot by slot."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from kinweave.functions import columns as C
from kinweave.operators import codecs, marginals, permute, siblings
from kinweave.operators.privacy import sigma
from kinweave.operators.siblings import Draw
from kinweave.plans.model import _GAUSS
from kinweave.plans.relational import _LINE, _MD5, LINE, query, r6
from kinweave.sources.tables import table

SLOTS, BUDGET, SEED = 4, 2.0, 3
VALUES = {"o_orderpriority": codecs.PRIORITY, "flag": codecs.FLAG, "status": codecs.LINE_STATUS}
#: Each flag follows the two members before, each status its own member's flag and the flag before.
DRAWS = [Draw("o_orderpriority", ())] + [
    Draw(f"m{t}_{a}", given)
    for t in range(SLOTS)
    for a, given in (
        ("flag", tuple(f"m{s}_flag" for s in range(max(t - 2, 0), t)) or ("o_orderpriority",)),
        ("status", (f"m{t}_flag", *[f"m{s}_flag" for s in range(max(t - 1, 0), t)])),
    )
]
#: The same without other members.
ALONE = [Draw(d.target, tuple(c for c in d.given if siblings.slot_of(c) in (-1, d.slot))) for d in DRAWS]
_SHARE = 0.6


def _linked(spark, d):
    """Lineitems whose flags follow their order in a share of the rows: members of a group depend on each other."""
    flag = F.element_at(F.array(*map(F.lit, codecs.FLAG)), (C.md5_int(F.concat(F.col("l_orderkey").cast("string"), F.lit("f"))) % 3 + 1).cast("int"))
    li = table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "status").withColumn("flag", F.col("l_returnflag"))
    return codecs.inject(li, "flag", flag, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), _SHARE)


def _members(spark, d):
    order = [F.col("status" if c == "l_linestatus" else c) for c in LINE]
    return permute.numbered(_linked(spark, d), "l_orderkey", order, SLOTS)


def _given(spark, d):
    order = [F.col("status" if c == "l_linestatus" else c) for c in LINE]
    return _linked(spark, d), "l_orderkey", ["flag", "status"], table(spark, d, "orders"), "o_orderkey", ["o_orderpriority"], order


def _counted(spark, d):
    return siblings.kinds_of(*_given(spark, d), SLOTS)


def _synthetic(spark, d, draws, counted):
    *tables, order = _given(spark, d)
    wide, _ = siblings.synthesise(*tables, VALUES, order, SLOTS, BUDGET, draws, seed=SEED, counted=counted)
    return wide


# ---- the same in SQL ---------------------------------------------------------------------------

_COLUMN = {"flag": "flag", "status": "l_linestatus", "o_orderpriority": "o_orderpriority"}
_MEMBERS = f"""k AS (SELECT *, CASE WHEN {_MD5.format("l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey")} < {int(_SHARE * 2**32)} THEN {codecs.FLAG}[({_MD5.format("l_orderkey || 'f'")} % 3 + 1)::INT] ELSE l_returnflag END AS flag FROM lineitem),
    mm AS (SELECT l_orderkey, flag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS rn FROM k),
    m AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM mm WHERE rn <= {SLOTS})"""


def _noise(key: str) -> str:
    return f"round({_GAUSS.format(f'({SEED} || ' + repr('#') + f' || {key})')}, 6)"


def _table_sql(name: str, d: Draw, per: float) -> str:
    names = siblings.canonical([*d.given, d.target])
    slots = max(1, len({siblings.slot_of(c) for c in names} - {-1}))
    place = lambda c: f"a{siblings.slot_of(names[c])}.{_COLUMN[siblings.attr_of(c)]}" if siblings.slot_of(c) >= 0 else c
    joins = "".join(f" JOIN m a{t} ON a{t}.l_orderkey = a0.l_orderkey" + "".join(f" AND a{t}.rn <> a{s}.rn" for s in range(t)) for t in range(1, slots))
    weight = "1.0::DOUBLE / a0.n" + "".join(f" / (a0.n - {t})" for t in range(1, slots)) if slots > 1 or siblings.slot_of(names[d.target]) >= 0 or any(siblings.slot_of(c) >= 0 for c in names) else "1.0::DOUBLE"
    first = " AND a0.rn = 1" if weight == "1.0::DOUBLE" else ""
    grid = f"unnest(range({max(d.slot, 0) + (d.slot >= 0)}, {SLOTS + 1})) AS size" if d.slot >= 0 else f"unnest(range(1, {SLOTS + 1})) AS size"
    cells = f"(SELECT {grid}) s" + "".join(f" CROSS JOIN (SELECT unnest({VALUES[siblings.attr_of(c)]}) AS {c}) g_{c}" for c in names)
    key = f"'{d.target}|' || size" + "".join(f" || '|' || {c}" for c in names)
    cols = ", ".join(names)
    return f"""{name}_m AS (SELECT a0.n AS size, {", ".join(f"{place(c)} AS {c}" for c in names)}, sum({weight}) AS v FROM m a0{joins} JOIN orders ON o_orderkey = a0.l_orderkey WHERE a0.n > {d.slot}{first} GROUP BY ALL),
    {name}_n AS (SELECT size, {cols}, (greatest(floor((round(coalesce(v, 0), 6) + {sigma(1, per)!r}::DOUBLE * {_noise(key)}) * 1000 + 0.5), 0) + 1)::BIGINT AS n FROM {cells} LEFT JOIN {name}_m USING (size, {cols})),
    {name} AS (SELECT *, sum(n) OVER (PARTITION BY size{"".join(f", {c}" for c in d.given)} ORDER BY {d.target}) AS hi, sum(n) OVER (PARTITION BY size{"".join(f", {c}" for c in d.given)}) AS total FROM {name}_n)"""


def _wide_sql(prefix: str, draws: list[Draw]) -> str:
    """CTEs that end in {prefix}: one row per new group."""
    per = BUDGET * siblings.SHARES["marginals"] / len(draws)
    fresh = f"floor(n + {sigma(1, BUDGET * siblings.SHARES['sizes'])!r}::DOUBLE * " + _noise("'size|' || size") + " + 0.5)"
    ctes = [f'{prefix}0 AS (SELECT size || {"-"!r} || copy AS "group", size FROM (SELECT size, unnest(range(1, greatest({fresh}, 0)::BIGINT + 1)) AS copy FROM (SELECT size, count(*) AS n FROM (SELECT least(count(*), {SLOTS}) AS size FROM k GROUP BY l_orderkey) GROUP BY 1)))']
    for i, d in enumerate(draws):
        ctes.append(_table_sql(f"{prefix}_t{i}", d, per))
        u = _MD5.format(f"'{d.target}#' || g.\"group\"") + "::HUGEINT * t.total"
        on = " AND ".join(["g.size = t.size", *[f"g.{c} IS NOT DISTINCT FROM t.{c}" for c in d.given], f"{u} >= (t.hi - t.n)::HUGEINT * 4294967296", f"{u} < t.hi::HUGEINT * 4294967296"])
        ctes.append(f"{prefix}{i + 1} AS (SELECT g.*, t.{d.target} FROM {prefix}{i} g LEFT JOIN {prefix}_t{i} t ON {on})")
    return ", ".join([*ctes, f"{prefix} AS (SELECT * FROM {prefix}{len(draws)})"])


def _rows_sql(prefix: str) -> str:
    return " UNION ALL ".join(f'SELECT "group", {t + 1} AS rn, size AS n, o_orderpriority, m{t}_flag AS flag, m{t}_status AS status FROM {prefix} WHERE size > {t}' for t in range(SLOTS))


def _pairs_sql(rows: str, key: str) -> str:
    return f"SELECT x, y, w / sum(w) OVER () AS v FROM (SELECT a.flag AS x, b.flag AS y, sum(1.0::DOUBLE / a.n / (a.n - 1)) AS w FROM {rows} a JOIN {rows} b ON a.{key} = b.{key} AND a.rn <> b.rn GROUP BY 1, 2)"


# ---- queries -----------------------------------------------------------------------------------

_FLAT = {"o_orderpriority": "o_orderpriority", "m0_flag": "a.flag", "m0_status": "a.l_linestatus", "m1_flag": "b.flag", "m1_status": "b.l_linestatus"}
_COUNTED = " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, {_FLAT[x]} AS x, {_FLAT[y]} AS y, sum(1.0::DOUBLE / a.n / (a.n - 1)) AS v FROM pair GROUP BY ALL".replace("a.", "a_").replace("b.", "b_") for x, y in combinations(_FLAT, 2))
_PAIR = "pair AS (SELECT a.flag AS a_flag, a.l_linestatus AS a_l_linestatus, b.flag AS b_flag, b.l_linestatus AS b_l_linestatus, a.n AS a_n, o_orderpriority FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND a.rn <> b.rn JOIN orders ON o_orderkey = a.l_orderkey WHERE a.n > 1)"


@query(f"""WITH {_MEMBERS}, {_PAIR}, c AS ({_COUNTED}), f AS (SELECT *, sum(v) OVER (PARTITION BY a, b, x) * sum(v) OVER (PARTITION BY a, b, y) / sum(v) OVER (PARTITION BY a, b) AS free, sum(v) OVER (PARTITION BY a, b) AS n FROM c)
    SELECT a, b, round((sum(abs(v - free)) + max(n) - sum(free)) / 2, 4) AS score FROM f GROUP BY a, b""")
def sibling_scores(spark, d):
    """Dependence scores of the parent's and two members' attributes."""
    scores = siblings.member_scores(_members(spark, d), "l_orderkey", ["flag", "status"], table(spark, d, "orders"), "o_orderkey", ["o_orderpriority"])
    return scores.withColumn("score", F.round("score", 4))


@query(f'WITH {_MEMBERS}, {_wide_sql("g", DRAWS)} SELECT "group", rn::INT AS rn, n, o_orderpriority, flag, status FROM ({_rows_sql("g")})')
def synth_siblings(spark, d):
    """New groups of lineitems, member by member."""
    wide = _synthetic(spark, d, DRAWS, _counted(spark, d))
    return siblings.member_rows(wide, ["flag", "status"], SLOTS, ("o_orderpriority",))


@query(f"""WITH {_MEMBERS}, {_wide_sql("g", DRAWS)}, {_wide_sql("h", ALONE)}, gr AS ({_rows_sql("g")}), hr AS ({_rows_sql("h")}), true AS ({_pairs_sql("m", "l_orderkey")}), gp AS ({_pairs_sql("gr", '"group"')}), hp AS ({_pairs_sql("hr", '"group"')})
    SELECT 'siblings' AS method, round(sum(abs(coalesce(t.v, 0) - coalesce(s.v, 0))) / 2, 6) AS distance FROM true t FULL JOIN gp s USING (x, y) UNION ALL SELECT 'alone', round(sum(abs(coalesce(t.v, 0) - coalesce(s.v, 0))) / 2, 6) FROM true t FULL JOIN hp s USING (x, y)""".replace("true AS", "truth AS").replace("FROM true t", "FROM truth t"))
def sibling_distance(spark, d):
    """Distance of the flags of two members, real and drawn: with and without regard to other members."""
    truth = siblings.pair_shares(_members(spark, d), "l_orderkey", "flag")
    counted, out = _counted(spark, d), None
    for name, draws in (("siblings", DRAWS), ("alone", ALONE)):
        drawn = siblings.wide_pair_shares(_synthetic(spark, d, draws, counted), "flag", SLOTS)
        one = marginals.tvd(truth, drawn, ["m0_flag", "m1_flag"]).select(F.lit(name).alias("method"), r6("distance").alias("distance"))
        out = one if out is None else out.unionByName(one)
    return out
