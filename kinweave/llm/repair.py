"""Conversation structure repair by layers of cost over a small grammar.

Roles should read `(s?(ua)+)?`. A conversation is a string with a letter for each row; a turn's word holds, for
each cost above its base, the bitset of grammar states from which the rest is accepted at exactly that cost.
Words go from the end to the start by shifts, as in Wu and Manber's search with errors; the first layer of
the first word that holds the start state is the cost, and the bits lead the least audit forward.

From any two states the cheapest rests differ by 10 at most (one or two insertions and a deletion lead from
one to the other), so 16 layers above the least one are enough, whatever the length: a word has 64 bits.

Long conversations are cut into segments. A segment's 4 x 4 table of least costs from state to state stands for
it; tables are folded, FOLD at a time, into those of segments of segments, so no task sees a whole
conversation. Costs come down again to each segment's end, then states to each segment's start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Scratch
from kinweave.operators.ordered import number_within
from kinweave.sources.scratch import saved

#: Rows of a segment, and segments folded into one.
SEGMENT, FOLD = 1024, 1024
#: Costs of the edits; undeleted truncated rows add TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a first system row, after user, after assistant. What is accepted in each state,
#: and the role that can be inserted or given there (it leads to the state of that role).
START, SYSTEM, USER, ASSISTANT = range(4)
_ACCEPTS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_ROLES = {"u": "user", "a": "assistant"}
#: Least cost from each state at the end of a conversation: insertions only.
END = (0, 6, 3, 0)
_FAR = 1 << 50
_ONES = sum(1 << (4 * k) for k in range(40))
#: Rows by initial: kept at no cost, truncated, and to be deleted.
_WHOLE, _CUT, _GONE = "suao", "SUAO", "0123"

# ---- layers ------------------------------------------------------------------------------------


def _before(word: int, initial: str) -> int:
    """States that accept a row of this initial into a state of the word, in all layers at once."""
    if initial == "s":
        return (word >> SYSTEM) & _ONES
    if initial == "u":
        into = (word >> USER) & _ONES
        return into | into << SYSTEM | into << ASSISTANT
    return ((word >> ASSISTANT) & _ONES) << USER if initial == "a" else 0


def _inserted(word: int) -> int:
    return _before(word, "u") | _before(word, "a")


def _leveled(word: int, base: int) -> tuple[int, int]:
    low = ((word & -word).bit_length() - 1) // 4
    return (word >> (4 * low)) & ((1 << 64) - 1), base + low


def _word(costs: Iterable[int]) -> tuple[int, int]:
    return _leveled(*_packed(tuple(costs)))


def _packed(costs: tuple[int, ...]) -> tuple[int, int]:
    base = min(costs)
    return sum(1 << (4 * (c - base) + q) for q, c in enumerate(costs) if c - base < 16), base


def _words(code: str, end: Iterable[int]) -> list[tuple[int, int]]:
    """(word, base) before each row of the code, and at its end."""
    out = [_word(end)]
    for letter in reversed(code):
        word, base = out[-1]
        before = word << (4 * DELETE)
        if letter not in _GONE:
            cut = 4 * TRUNCATED if letter in _CUT else 0
            before |= _before(word, letter.lower()) << (4 * KEEP + cut) | _inserted(word) << (4 * REROLE + cut)
        for _ in range(2):  # more insertions in a row never pay
            before |= _inserted(before) << (4 * INSERT)
        out.append(_leveled(before, base))
    return out[::-1]


def _costs(word: int, base: int) -> list[int]:
    """The least cost from each state."""
    found = [(word >> q) & _ONES for q in range(4)]
    return [base + ((x & -x).bit_length() - 1) // 4 if x else _FAR for x in found]


def table(code: str) -> list[int]:
    """Least costs from each state before the rows to each state after them, row by row."""
    columns = [_costs(*_words(code, [0 if q == end else _FAR for q in range(4)])[0]) for end in range(4)]
    return [columns[end][q] for q in range(4) for end in range(4)]


def trace(code: str, end: Iterable[int], state: int, last: bool) -> tuple[int, int, list[tuple[str, str, str]]]:
    """(cost, state after the rows, edits) of the least audit from a state: for each row the roles inserted
    before it, its edit and the role given to it; the last segment has a final entry for insertions only."""
    words = _words(code, end)
    left = start = _costs(*words[0])[state]
    edits, new, i = [], "", 0

    def holds(at: int, cost: int, q: int) -> bool:
        word, base = words[at]
        layer = left - cost - base
        return 0 <= layer < 16 and bool(word >> (4 * layer + q) & 1)

    while True:
        if i == len(code):
            if not last:
                return start - left, state, edits
            if left == 0 and state in (START, ASSISTANT):
                return start, state, [*edits, (new, "", "")]
        letter = code[i] if i < len(code) else ""
        cut = TRUNCATED if letter and letter in _CUT else 0
        given = _NEXT[state]
        goes = _ACCEPTS[state]
        # in ASCII order: D, I, K, R
        if letter and holds(i + 1, DELETE, state):
            edits.append((new, "D", ""))
            left, new, i = left - DELETE, "", i + 1
        elif holds(i, INSERT, goes[given]):
            left, new, state = left - INSERT, new + given, goes[given]
        elif letter not in _GONE and letter.lower() in goes and holds(i + 1, KEEP + cut, goes[letter.lower()]):
            edits.append((new, "K", ""))
            left, new, state, i = left - KEEP - cut, "", goes[letter.lower()], i + 1
        else:
            edits.append((new, "R", given))
            left, new, state, i = left - REROLE - cut, "", goes[given], i + 1


def _compose(a: list[int], b: list[int]) -> list[int]:
    return [min(a[4 * q + k] + b[4 * k + end] for k in range(4)) for q in range(4) for end in range(4)]


def _mapped(f: Callable, inputs: list[str], schema: str):
    """mapInArrow over rows: f of the inputs gives the further columns; equal inputs are worked out once a
    batch."""
    names = [x.split(" ")[0].split(":")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict = {}
            given = [tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in zip(*[batch.column(c).to_pylist() for c in inputs], strict=True)]
            found = [known[x] if x in known else known.setdefault(x, f(*x)) for x in given]
            yield pa.RecordBatch.from_pylist([dict(zip(names, (g, s, *x), strict=True)) for g, s, x in zip(batch.column("g").to_pylist(), batch.column("seg").to_pylist(), found, strict=True)], schema=_ARROW[schema])

    return run


_TABLES = "g string, seg long, m array<bigint>"
_STATES = "g string, seg long, exits array<bigint>"
_SOLVED = "g string, seg long, cost long, illegal long, audit string, edits array<string>"
_ARROW = {
    _TABLES: pa.schema([("g", pa.string()), ("seg", pa.int64()), ("m", pa.list_(pa.int64()))]),
    _STATES: pa.schema([("g", pa.string()), ("seg", pa.int64()), ("exits", pa.list_(pa.int64()))]),
    _SOLVED: pa.schema([("g", pa.string()), ("seg", pa.int64()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(pa.string()))]),
}


def _solve(segment: int):
    def run(code: str, after: tuple[int, ...], state: int) -> tuple:
        body, last = code[:segment], len(code) <= segment
        initials = "".join("suao"[int(x)] if x in _GONE else x.lower() for x in code)
        illegal = sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))
        cost, _, edits = trace(body, after, state, last)
        return cost, illegal, "".join("I" * len(new) + edit for new, edit, _ in edits), ["".join(e) for e in edits]

    return run


# ---- segments ----------------------------------------------------------------------------------


def _folded(segs: DataFrame, column: str, fold: int) -> DataFrame:
    """(g, seg, items): `fold` segments in a row as one array of (seg, column), in order."""
    return segs.groupBy("g", F.floor(F.col("seg") / fold).alias("up")).agg(F.array_sort(F.collect_list(F.struct("seg", column))).alias("items")).withColumnRenamed("up", "seg")


def _unfolded(scanned: DataFrame, name: str) -> DataFrame:
    return scanned.select("g", F.explode("items").alias("x")).select("g", F.col("x.seg").alias("seg"), F.col(f"x.{name}").alias(name))


def _product(items):
    out = items[0][1]
    for x in items[1:]:
        out = _compose(out, x[1])
    return out


def _afters(items, after):
    out = []
    for seg, m in reversed(items):
        out.append((seg, list(after)))
        after = [min(m[4 * q + k] + after[k] for k in range(4)) for q in range(4)]
    return out


def _chained(items):
    state = list(range(4))
    for x in items:
        state = [x[1][q] for q in state]
    return state


def _entered(items, state):
    out = []
    for seg, exits in items:
        out.append((seg, state))
        state = exits[state]
    return out


_TYPES = {_product: "array<bigint>", _chained: "array<bigint>", _afters: "array<struct<seg:bigint,after:array<bigint>>>", _entered: "array<struct<seg:bigint,entry:bigint>>"}


def _scanned(segs: DataFrame, column: str, fold: int, product: Callable, scan: Callable, first: Column, name: str) -> DataFrame:
    """(g, seg, name): a scan over each conversation's segments, by folding them until one is left."""
    product, scan = (F.udf(f, _TYPES[f]) if f in _TYPES else f for f in (product, scan))
    up = saved(_folded(segs, column, fold))
    if up.filter("seg > 0").isEmpty():
        return _unfolded(up.withColumn("items", scan("items", first)), name)
    above = _scanned(up.select("g", "seg", product("items").alias(column)), column, fold, product, scan, first, name)
    return _unfolded(up.join(above, ["g", "seg"]).withColumn("items", scan("items", name)), name)


# ---- rows --------------------------------------------------------------------------------------


def _group(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by crc32 of `conv_id:turn` (null: a space) modulo 20: 0 drops
    the row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes it a user's. A null role or text
    becomes one space."""
    kind = F.crc32(F.concat(_group(F.col("conv_id")), F.lit(":"), _group(F.col("turn"))).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.withColumn("_kind", kind).filter("_kind <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(role).alias("role"), text.alias("text"), "_kind")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


_INK = r"[^\x20\x09-\x0D]"


def numbered_turns(rows: DataFrame) -> DataFrame:
    """g, conv_id, turn, role, text and pos: the row's place in its conversation, by turn (nulls first), then
    role and the text's digest."""
    rows = rows.select(_group(F.col("conv_id")).alias("g"), F.col("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("_text", F.sha2(F.col("text").cast("binary"), 256))
    return number_within(rows, ["g"], [F.asc_nulls_first("turn"), F.col("role"), F.col("_text")], "pos")


def faults(turns: DataFrame) -> DataFrame:
    """g, pos, turn, initial, and the row's first fault: blank, duplicate or truncated, else null."""
    last = F.regexp_extract("text", rf"({_INK})[\x20\x09-\x0D]*\z", 1)
    slim = turns.select("g", "pos", "turn", F.substring("role", 1, 1).alias("initial"), last.alias("_last"), F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("_text")).cast("binary"), 256).alias("_same"))
    seen = number_within(slim, ["g", "_same"], [F.col("pos")], "_seen")
    fault = F.when(F.col("_last") == "", "blank").when(F.col("_seen") > 0, "duplicate").when(~F.col("_last").isin(".", "!", "?"), "truncated")
    return seen.select("g", "pos", "turn", "initial", fault.alias("fault"))


def _codes(found: DataFrame, segment: int) -> DataFrame:
    """(g, seg, code): a letter for each row; a segment that isn't the last has the next one's first row too."""
    place = F.greatest(F.instr(F.lit("sua"), F.col("initial")), F.lit(0))
    known = F.when((F.col("initial") != "") & (place > 0), place).otherwise(4)
    letters = F.when(F.col("fault") == "truncated", F.lit(_CUT)).when(F.col("fault").isNotNull(), F.lit(_GONE)).otherwise(F.lit(_WHOLE))
    seg = F.floor(F.col("pos") / segment)
    both = F.when((F.col("pos") % segment == 0) & (F.col("pos") > 0), F.array(seg, seg - 1)).otherwise(F.array(seg))
    rows = found.select("g", "pos", letters.substr(known, F.lit(1)).alias("letter"), F.explode(both).alias("seg"))
    return rows.groupBy("g", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("code"))


def solved(found: DataFrame, segment: int = SEGMENT, fold: int = FOLD) -> DataFrame:
    """(g, seg, cost, illegal, audit, edits) of each segment of `segment` rows."""
    segs = saved(_codes(found, segment))
    long = segs.filter("seg = 1").select("g")
    end = F.array(*[F.lit(x).cast("long") for x in END])
    full = segs.withColumns({"after": end, "entry": F.lit(0).cast("long")})
    if not long.isEmpty():
        body = segs.join(long, "g", "left_semi").withColumn("code", F.substring("code", 1, segment))
        tables = body.mapInArrow(_mapped(lambda code: (table(code),), ["code"], _TABLES), _TABLES)
        after = saved(_scanned(tables, "m", fold, _product, _afters, end, "after"))
        exits = body.join(after, ["g", "seg"]).mapInArrow(_mapped(lambda code, after: ([trace(code, after, q, False)[1] for q in range(4)],), ["code", "after"], _STATES), _STATES)
        entry = saved(_scanned(exits, "exits", fold, _chained, _entered, F.lit(0).cast("long"), "entry"))
        full = segs.join(after.join(entry, ["g", "seg"]), ["g", "seg"], "left").withColumns({"after": F.coalesce("after", end), "entry": F.coalesce("entry", F.lit(0).cast("long"))})
    return saved(full.mapInArrow(_mapped(_solve(segment), ["code", "after", "entry"], _SOLVED), _SOLVED))


def _lines(turns: DataFrame, edits: DataFrame, segment: int) -> DataFrame:
    """(g, pos, lines): the repaired (role, text) at each place, those inserted before the row first."""
    each = edits.select("g", "seg", F.posexplode("edits").alias("k", "edit")).select("g", (F.col("seg") * segment + F.col("k")).alias("pos"), "edit")
    each = each.select("g", "pos", F.regexp_extract("edit", "^[ua]*", 0).alias("new"), F.regexp_extract("edit", "[DKR]", 0).alias("kind"), F.regexp_extract("edit", "R(.)", 1).alias("given"))
    named = lambda x: F.when(x == "u", _ROLES["u"]).otherwise(_ROLES["a"])
    line = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    new = F.transform(F.filter(F.split("new", ""), lambda x: x != ""), lambda x: line(named(x), F.lit("")))
    role = F.when(F.col("kind") == "R", named(F.col("given"))).otherwise(F.col("role"))
    own = F.when(F.col("kind").isin("K", "R"), F.array(line(role, F.col("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return each.join(turns.select("g", "pos", "role", "text"), ["g", "pos"], "left").select("g", "pos", F.concat(new, own).alias("lines"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per conversation, fed line by line: rows come sorted, none is kept."""
    key, digest, first = None, None, True
    for batch in batches:
        done: list[tuple[str, str]] = []
        for g, lines in zip(batch.column("g").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if g != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest, first = g, hashlib.sha256(), True
            for line in lines:
                digest.update(("" if first else "\n").encode() + f"{line['role']}:{line['text']}".encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in range(2)], names=["g", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["g", "repaired_sha256"])


def repair(rows: DataFrame, ids: DataFrame | None = None, segment: int = SEGMENT, fold: int = FOLD) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows (conv_id, turn, role, text) go by turn, nulls first; rows that tie go by role, then by their text's
    digest, equal rows side by side. A row's first fault counts: blank, duplicate (role and text of an earlier
    row), truncated. Edits are Keep, Rerole, Delete and Insert; audit is the least of the cheapest ones in
    ASCII order. `ids` (conv_id) names further conversations without rows: zeros and an empty audit.

    A null role or text is one space, a null conv_id a conversation of its own; gaps leave null turns out and
    are 0 without others. Roles of other initials can't be kept; an empty role has none. Empty tables give
    the rows of `ids`. Texts of any length pass by their digest and last character. Other columns are
    ignored. A conversation of most rows is numbered in ranges and repaired in segments; only the digest of its
    repaired lines, one number over all of them in order, streams through one task, which keeps no line.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    turns = scratch.save(numbered_turns(rows))
    found = scratch.save(faults(turns))
    edits = solved(found, segment, fold)
    counts = [F.count(F.when(F.col("fault") == x, 1)).alias(x) for x in ("blank", "duplicate", "truncated")]
    stats = found.groupBy("g", "turn").agg(*counts).groupBy("g").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "")
    totals = edits.groupBy("g").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), audit.alias("audit"))
    digests = _lines(turns, edits, segment).repartition("g").sortWithinPartitions("g", "pos").mapInArrow(_digests, "g string, repaired_sha256 string")
    names = (ids if ids is not None else rows).select("conv_id").distinct().withColumn("g", _group(F.col("conv_id")))
    out = names.join(stats, "g", "left").join(totals, "g", "left").join(digests, "g", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repaired_rows(rows: DataFrame, segment: int = SEGMENT, fold: int = FOLD) -> DataFrame:
    """The repaired conversations as rows: conv_id, number (from 0), role, text. Cases as in `repair`."""
    turns = saved(numbered_turns(rows))
    lines = _lines(turns, solved(saved(faults(turns)), segment, fold), segment).select("g", "pos", F.posexplode("lines").alias("k", "line"))
    lines = number_within(lines, ["g"], [F.col("pos"), F.col("k")], "number")
    return lines.select(F.when(F.col("g") != " ", F.col("g")).cast(rows.schema["conv_id"].dataType).alias("conv_id"), "number", "line.role", "line.text")
