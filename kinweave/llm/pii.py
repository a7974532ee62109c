"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose spans with high recall. Those that pass the format's own test (the base spans)
stay. The others are scored by boosted trees on format and context features. The trees are fitted by
MLlib on generated candidates that are put into passages of the corpus at hand; a logistic fit on held-back
ones turns their margin into a probability (Platt), and thresholds are set on further ones. All of it is
written out as one SQL expression, so scoring needs no UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import bare, release_driver

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The contract's patterns, written so that Java's engine takes linear time and constant stack: runs
#: are possessive, and a match starts at a run's start or at the end of the match before (\G).
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?=[0-9](?:[\x20-]?[0-9]){12})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a pattern can't match, looked for first.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_AT, _DOT = r"\x20?[\[({<]\x20?at\x20?[\])}>]\x20?", r"(?:\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?|\x20dot\x20)"
#: Generators beside the base ones: addresses with at or dot spelled out, in brackets or set apart by
#: spaces; colon-separated addresses, short forms too; numbers without a country code; dotted card numbers.
LOOSE = {
    "email": rf"(?i)(?<!{_LOCAL}){_LOCAL}++(?:{_AT}{_HOST}++(?:(?:{_DOT}|\.){_HOST}++)++|(?:\x20at\x20|@){_HOST}++(?:{_DOT}{_HOST}++)++|\x20@\x20{_HOST}++(?:(?:{_DOT}|\x20?\.){_HOST}++)++)",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.])",
    "phone": r"(?<![0-9A-Za-z+.,:/-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}+[\x20./-])[0-9]{2,8}+(?:[\x20./-][0-9]{2,8}+){0,4}(?![0-9A-Za-z:%])",
}
#: Context words, looked for in the CONTEXT_CHARS characters before a candidate.
CONTEXT = {
    "contact": r"(?i)\b(?:call|phone|tel|telephone|telefon|tel[eé]fono|t[eé]l[eé]phone|mobile|m[oó]vil|cell|handy|fax|dial|ring|reach|text|contact|kontakt|number|nummer|n[uú]mero|num[eé]ro|rufen|anrufen|ruf|llame|llama|llamar|appelez|appeler|whatsapp|sms|e-?mail|mail|write|address)\b",
    "payment": r"(?i)\b(?:card|karte|carte|tarjeta|visa|mastercard|amex|credit|debit|payment|pay)\b",
    "network": r"(?i)\b(?:ip|ipv6|host|server|login|client|remote|address|ping|connect|connected|ssh|node|router|gateway|peer|from)\b",
    "other": r"(?i)\b(?:order|invoice|isbn|version|page|pages|date|dated|part|serial|ref|item|total|table|score|code|id|vol|no|time|at|bestellung|rechnung|pedido|factura|commande|facture|between|chapter|model|batch)\b",
}
CONTEXT_CHARS = 40
FEATURES = (
    "kind", "loose", "n_chars", "n_digits", "n_seps", "bracket", "dots", "luhn", "contact", "payment", "network", "other", "letter_before", "letter_after", "year", "tld",
    "colons", "short_form", "hex_letters", "valid_v6", "spelled_dot", "zero_first", "groups", "first_group", "second_group", "last_group", "one_separator", "date",
)
TOP_LEVEL = r"(?i)(?<![A-Za-z0-9])(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"
#: Generated candidates, corpus passages they are put into, words of a passage on each side, and the
#: share of personal data among held-back candidates that each kind's threshold is set for.
GENERATED, HOSTS, HOST_WORDS, PRECISION = 7200, 400, 8, 0.99


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True for a string of at most 19 digits that passes the Luhn test."""
    pairs = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.try_to_number(d, F.lit("9")).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)) - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]|)"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(F.lit(False))
    return n.between(9, 15)


#: Items that one pass adds up: a list grows by copies, so long lists are built from blocks.
BLOCK = 64


def _bound(value: Column, of) -> Column:
    """`of` applied to a value that is computed once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _blocks(items: Column) -> Column:
    """items in arrays of BLOCK each."""
    n = F.size(items)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(n > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def _before(items: Column, value, join) -> Column:
    """For each item what `join` makes of the values of those before it, 0 for the first: time grows with the
    items, not with their square."""

    def scan(start: Column, xs: Column, of) -> Column:
        step = lambda acc, x: F.struct(join(acc["at"], of(x)).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(xs, F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    blocks = _blocks(items)
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: join(a, value(x)).cast("int")))
    return F.flatten(F.zip_with(blocks, scan(F.lit(0), totals, lambda t: t), lambda b, start: scan(start, b, value)))


_MATCHES = "array<struct<gap:string,m:string,next:string>>"
_CANDIDATE = "array<struct<kind:int,loose:boolean,start:int,end:int,value:string,base:boolean,before:string,after:string>>"


def _matches(kind: str, loose: bool, text: Column) -> Column:
    """(gap, m, next): each match with the text before it and after it, up to the next one. The pattern runs a
    second time, for the gaps, only where it matches."""
    pattern = (LOOSE if loose else BASE)[kind]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    each = F.slice(F.arrays_zip(gaps.alias("gap"), found.alias("m"), F.slice(gaps, F.lit(2), F.size(found)).alias("next")), F.lit(1), F.size(found))
    need = NEEDS.get(kind) if not loose else {"ip": ":", "card": "."}.get(kind)
    here = text.rlike(pattern) if need is None else F.contains(text, F.lit(need)) & text.rlike(pattern)
    return F.when(here, each).otherwise(F.array().cast(_MATCHES))


def _spans(kind: str, loose: bool, each: Column, starts: Column) -> Column:
    """All candidates of one generator, with their places and what stands around them."""

    def one(x: Column, before: Column) -> Column:
        start = before + F.length(x["gap"])
        base = F.lit(False) if loose else _valid(kind, x["m"])
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), F.lit(loose).alias("loose"), start.cast("int").alias("start"), (start + F.length(x["m"])).cast("int").alias("end"), x["m"].alias("value"), base.alias("base"),
            F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"),
        )

    return F.zip_with(each, starts, one).cast(_CANDIDATE)


def candidates(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text (null: empty), and the array of all candidates, which may
    overlap."""
    text = F.coalesce("text", F.lit(""))
    reach = lambda x: F.length(x["gap"]) + F.length(x["m"])

    def generator(k: str, loose: bool) -> Column:
        placed = lambda m: _bound(_before(m, reach, lambda a, b: a + b), lambda at: _spans(k, loose, m, at))
        return _bound(_matches(k, loose, text), placed)

    # one expression a generator, with its parts bound in it: as columns of their own they would be written out
    # again and again in any filter that the optimiser pushes down
    found = [generator(k, loose) for loose in (False, True) for k in KINDS]
    # a number that fails the base test of an address is none; too few or too many digits are no phone number
    real = lambda c: c["base"] | F.when(c["kind"] == KINDS.index("ip"), c["loose"]).when(c["kind"] == KINDS.index("phone"), F.length(_digits(c["value"])).between(6, 15)).otherwise(True)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.filter(F.concat(*found), real).alias("candidates"))


def features(c: Column) -> Column:
    """What stands before a candidate is cut at the match of its own generator before it."""
    value, before, after = c["value"], c["before"], c["after"]
    group = lambda k: F.length(F.regexp_extract(value, rf"^[^0-9]*+(?:[0-9]++[^0-9]++){{{k}}}([0-9]++)", 1))
    n = F.length(_digits(value))
    got = {
        "kind": c["kind"], "loose": c["loose"], "n_chars": F.length(value), "n_digits": n,
        "n_seps": F.length(F.regexp_replace(value, r"[^\x20-]", "")), "bracket": value.rlike(r"[(\[]"), "dots": F.length(F.regexp_replace(value, r"[^.]", "")),
        "luhn": F.when(n.between(13, 19), luhn(_digits(value))).otherwise(F.lit(False)),
        **{name: before.rlike(pattern) for name, pattern in CONTEXT.items()},
        "letter_before": before.rlike(r"\p{L}$"), "letter_after": after.rlike(r"^\p{L}"),
        "year": value.rlike(r"^\(?(?:19|20)[0-9]{2}[\x20.)-]"), "tld": value.rlike(TOP_LEVEL),
        "colons": F.length(F.regexp_replace(value, "[^:]", "")), "short_form": F.contains(value, F.lit("::")), "hex_letters": F.length(F.regexp_replace(value, "[^A-Fa-f]", "")),
        "valid_v6": value.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | (value.rlike("^[^:]*(?::[^:]+)*::(?:[^:]+:)*[^:]*$") & value.rlike("[0-9A-Fa-f]{2}")), "spelled_dot": value.rlike("(?i)dot"),
        "zero_first": value.rlike(r"^\(?0"), "groups": F.size(F.split(F.regexp_replace(value, r"[^0-9]+$|^[^0-9]+", ""), "[^0-9]+")), "first_group": group(0), "second_group": group(1),
        "last_group": F.length(F.regexp_extract(value, r"(?<![0-9])([0-9]++)[^0-9]*+$", 1)), "one_separator": value.rlike(r"^[0-9]++([\x20./-])[0-9]++(?:\1[0-9]++)*+$"),
        "date": value.rlike(r"^(?:(?:19|20)[0-9]{2}[./-][01]?[0-9](?:[./-][0-3]?[0-9])?|[0-3]?[0-9][./-][0-3]?[0-9][./-](?:19|20)?[0-9]{2}|(?:1[5-9]|20)[0-9]{2}\x20?[-/]\x20?(?:1[5-9]|20)?[0-9]{2})$"),
    }
    return F.struct(*[got[f].cast("double").alias(f) for f in FEATURES])


# ---- the generated set and the trees -----------------------------------------------------------


def passages(docs: DataFrame, hosts: int = HOSTS, words: int = HOST_WORDS) -> DataFrame:
    """host (from 0), before, after: words around the middle of at most `hosts` texts, those whose
    doc_ids have the smallest hashes. Candidates for the fit are put between them; nothing is labelled by the corpus."""
    # texts stay where they are read: the hashes' limit comes first, from doc_id alone
    h = F.xxhash64("doc_id")
    upto = docs.select(h.alias("h")).orderBy("h").limit(hosts).agg(F.max("h")).first()[0]
    found = docs.filter((h <= F.lit(upto)) & (F.length("text") > 0)).withColumn("w", F.split("text", r"[\x20\x09-\x0D]+")).withColumn("mid", (F.size("w") / 2).cast("int"))
    cut = lambda a: F.array_join(F.slice("w", F.greatest(a, F.lit(1)), F.lit(words)), " ")
    found = found.select(cut(F.col("mid") + 1 - words).alias("before"), cut(F.col("mid") + 1).alias("after")).orderBy("before", "after").limit(hosts)
    return found.withColumn("host", F.row_number().over(Window.orderBy("before", "after")) - 1)


def generated(docs: DataFrame, rows: int = GENERATED) -> DataFrame:
    """doc_id, text, label, at: one candidate in a passage of the corpus (at its place `at`), from templates
    for personal data (1) and for look-alikes (0). Words and digits come from hashes, so the set is the
    same for the same corpus. Without any text the passages are empty."""

    def number(k: int, seed: int) -> Column:
        return F.lpad(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(10**k)).cast("string"), k, "0")

    def word(seed: int) -> Column:
        return F.translate(F.lpad(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(10**6)).cast("string"), 6, "3"), "0123456789", "aeiourntls")

    def pick(seed: int, *options: str) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(len(options))) + 1).cast("int"))

    def joined(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    sep, n3, m3, n4 = pick(1, "-", " ", "."), number(3, 2), number(3, 3), number(4, 4)
    block = lambda s: joined(number(4, s), sep, number(4, s + 1), sep, number(4, s + 2), sep, number(4, s + 3))
    call = pick(5, "call", "phone:", "tel", "mobile", "reach me on", "fax", "please text", "contact us at", "Telefon", "tel.:", "my number is", "call me at", "ring", "Nummer:", "rufen Sie", "llame al", "mon numéro:", "appelez le", "WhatsApp")
    pay = pick(6, "card", "visa card", "credit card no", "pay with", "mastercard", "Karte", "carte")
    plain = pick(7, "order", "invoice", "isbn", "version", "pages", "dated", "part", "serial", "ref", "item", "score", "table", "order number", "serial number", "part no", "Rechnung", "pedido", "between", "batch")
    boxed, boxed_dot = pick(8, " [at] ", " (at) ", "(at)", "[AT]", "{at}"), pick(9, " [dot] ", "(dot)", " (dot) ", "[DOT]")
    dot, tld = F.when(F.xxhash64("doc_id", F.lit(22)) % 2 == 0, F.lit(" dot ")).otherwise(boxed_dot), pick(12, "com", "org", "net", "de", "fr", "es")
    hexed = lambda k: F.lower(F.substring(F.hex(F.xxhash64("doc_id", F.lit(20 + k))), 1, 4))
    net = pick(13, "server", "login from", "host", "ip", "client", "ping", "seen", "connect to", "via")
    #: Numbers of the kinds in use in several countries: in threes and four, area codes in brackets, leading zeros.
    forms = [
        joined(n3, sep, m3, sep, n4), joined("(", n3, ")", pick(75, " ", ""), m3, pick(76, "-", " ", "."), n4), joined("0", number(2, 77), " ", number(4, 78), " ", n4),
        joined("0", number(2, 79), pick(80, "/", "-", " "), number(6, 81)), joined("0", number(2, 79), pick(80, "/", "-", " "), number(7, 81)), joined("0", number(3, 82), pick(83, " ", "/", "-"), number(7, 84)),
        joined("0", number(1, 85), " ", number(2, 86), " ", number(2, 87), " ", number(2, 88), " ", number(2, 89)),
    ]
    loose_forms = [joined(number(2, 90), " ", m3, " ", number(2, 91), " ", number(2, 92)), joined(m3, pick(93, "-", " "), n4), joined(number(2, 94), pick(95, " ", "/", "-"), number(7, 96))]
    year = joined(pick(16, "19", "20"), number(2, 17))
    small = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(90)).cast("string")
    templates = [
        *[(1, joined(call, " ", x)) for x in (*forms, *loose_forms)], *[(1, joined(word(97), " ", x)) for x in forms], *[(0, joined(plain, " ", x)) for x in (*forms, *loose_forms)],
        (1, joined(word(10), pick(25, " at ", "@"), word(11), dot, tld)), (1, joined("write to ", word(10), " at ", word(11), " dot ", tld)),
        (1, joined(word(10), boxed, word(11), F.when(F.xxhash64("doc_id", F.lit(26)) % 2 == 0, F.lit(".")).otherwise(boxed_dot), tld)), (1, joined(word(10), " @ ", word(11), pick(27, ".", " dot "), tld)),
        (1, joined(net, " ", F.concat_ws(":", *map(hexed, range(8))))), (1, joined(net, " ", hexed(0), ":", hexed(1), "::", hexed(2))), (1, joined(net, " fe80::", hexed(0), ":", hexed(1), ":", hexed(2), ":", hexed(3))),
        (1, joined(net, " 2001:", pick(98, "db8", "4860", "67c"), "::", F.substring(hexed(5), 1, 1))), (1, joined(word(99), " ", hexed(1), ":", hexed(2), "::", hexed(4))),
        (1, joined(pay, " ", block(30))), (1, joined(pay, " ", number(4, 30), ".", number(4, 31), ".", number(4, 32), ".", number(4, 33))),
        (0, joined(plain, " ", block(40))), (0, joined(word(15), " ", block(50))), (0, joined(plain, " ", number(4, 40), ".", number(4, 41), ".", number(4, 42), ".", number(4, 43))),
        (0, joined(pick(100, "", "on ", "dated "), year, "-0", number(1, 18), "-", pick(101, "0", "1", "2"), number(1, 19))), (0, joined(pick(100, "", "on ", "am "), pick(101, "0", "1", "2"), number(1, 19), pick(102, ".", "/", "-"), "0", number(1, 18), pick(102, ".", "/", "-"), year)),
        (0, joined(word(103), " ", year, "-", pick(104, "19", "20"), number(2, 105))), (0, joined(word(103), " ", small(106), " ", m3, " ", n3)), (0, joined(word(103), " ", number(2, 107), " ", number(2, 108), " ", number(2, 109))),
        (0, joined(word(103), " ", number(2, 110), "-", number(2, 111), "-", number(2, 112))), (0, joined(word(103), " ", number(2, 110), ".", number(3, 111), ".", number(3, 112))), (0, joined(word(103), " ", number(4, 113), " ", number(4, 114))), (0, joined(word(103), " ", number(5, 115), "-", number(4, 116))), (0, joined(word(103), " ", year, pick(117, " ", "/"), "20", number(2, 118), " 19", number(2, 119))),
        (0, joined(word(10), " at ", word(11), " dot ", word(12))), (0, joined(word(10), " @ ", word(11), ".", word(12))),
        (0, joined(pick(28, "at ", "time ", "on ", ""), number(2, 64), ":", number(2, 65), ":", number(2, 66))), (0, joined(pick(29, "a", "std ", "x "), "::", pick(31, "b", "d", "fa"))), (0, joined(number(1, 67), ":", number(1, 68), ":", number(2, 69), ":", number(2, 74))),
    ]
    kind = (F.col("doc_id") % len(templates) + 1).cast("int")
    text, label = F.element_at(F.array(*[t for _, t in templates]), kind), F.element_at(F.array(*[F.lit(y) for y, _ in templates]), kind)
    hosts = passages(docs).cache()
    n = max(1, hosts.count())
    made = docs.sparkSession.range(rows).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("made"), label.cast("double").alias("label"))
    placed = made.withColumn("host", F.pmod(F.xxhash64("doc_id"), F.lit(n))).join(F.broadcast(hosts), "host", "left")
    before = F.concat(F.coalesce("before", F.lit("")), F.lit(" "))
    return placed.select("doc_id", F.concat(before, F.col("made"), F.lit(" "), F.coalesce("after", F.lit(""))).alias("text"), "label", F.length(before).alias("at"), F.length("made").alias("made"))


def _nodes(node, depth: int, at: int, out: list) -> None:
    """A tree in an array: the children of node n are 2n + 1 and 2n + 2; feature -1 marks a leaf."""
    if "Internal" not in node.getClass().getSimpleName():
        out[at] = (-1, 0.0, node.prediction())
        return
    split = node.split()
    out[at] = (split.featureIndex(), split.threshold(), 0.0)
    _nodes(node.leftChild(), depth - 1, 2 * at + 1, out)
    _nodes(node.rightChild(), depth - 1, 2 * at + 2, out)


def _margin_sql(trees, weights, depth: int) -> str:
    """The weighted sum of all trees over a struct f of FEATURES, as walks through arrays: the expression is as
    small as one tree's, however many there are."""
    size, flat = 2 ** (depth + 1) - 1, []
    for t, w in zip(trees, weights, strict=True):
        one = [(-1, 0.0, 0.0)] * size
        _nodes(t._call_java("rootNode"), depth, 0, one)
        flat += [(a, b, w * c) for a, b, c in one]
    feature, threshold, value = (f"array({','.join(map(f, x))})" for f, x in zip((str, lambda v: f"{v!r}D", lambda v: f"{v!r}D"), zip(*flat, strict=True), strict=True))
    walk = f"aggregate(sequence(1, {depth}), 0, (n, _) -> if(feature[t * {size} + n] < 0, n, if(x[feature[t * {size} + n]] <= threshold[t * {size} + n], 2 * n + 1, 2 * n + 2)))"
    inner = f"aggregate(sequence(0, {len(trees) - 1}), 0D, (s, t) -> s + value[t * {size} + {walk}])"
    return f"transform(array(struct(array({','.join(f'f.{c}' for c in FEATURES)}) as x, {feature} as feature, {threshold} as threshold, {value} as value)), m -> {inner.replace('feature[', 'm.feature[').replace('threshold[', 'm.threshold[').replace('value[', 'm.value[').replace('x[', 'm.x[')})[0]"


class Booster:
    """Boosted trees and their calibration as one SQL expression over a struct f of FEATURES, a probability
    threshold by kind, and what held-back candidates say: {kind: (precision, recall)}."""

    def __init__(self, score: str, thresholds: dict[int, float], measured: dict[str, tuple[float, float]], model=None):
        self.score, self.thresholds, self.measured, self.model = score, thresholds, measured, model


def labelled(docs: DataFrame, rows: int = GENERATED) -> DataFrame:
    """doc_id, label, f: the features of the generated candidates of `generated`, not of the passages'
    own."""
    made = generated(docs, rows).cache()  # a few rows: the templates are not planned again by each pattern
    one = candidates(made).select("row.*", F.explode(F.filter("candidates", lambda c: ~c["base"])).alias("c"))
    mine = (F.col("c.start") >= F.col("at")) & (F.col("c.end") <= F.col("at") + F.col("made"))
    return one.filter(mine).select("doc_id", "label", features(F.col("c")).alias("f"))


def fit(docs: DataFrame, rows: int = GENERATED, precision: float = PRECISION, trees: int = 12, depth: int = 5) -> Booster:
    """Trees fitted on three fifths of the generated candidates, dealt by a hash; on a fifth, their margin is turned into a
    probability; on the last, each kind's threshold is the lowest probability of a half or more at which the
    share of personal data is at least `precision`. The generated set is of a fixed size, whatever the
    corpus."""
    one = labelled(docs, rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5))).repartition(1).cache()
    flat = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(one.filter("part < 3").select("label", "f.*"))
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, minInstancesPerNode=5).fit(flat)
    margin = _margin_sql(model.trees, model.treeWeights, depth)
    scored = VectorAssembler(inputCols=["m"], outputCol="x").transform(one.filter("part = 3").selectExpr("label", f"{margin} as m"))
    platt = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-3).fit(scored)
    score = f"1D / (1D + exp(-({float(platt.coefficients[0])!r}D * ({margin}) + ({float(platt.intercept)!r}D))))"
    held = one.filter("part = 4").selectExpr("cast(f.kind as int) as kind", "label", f"{score} as p").collect()
    one.unpersist()
    release_driver(docs.sparkSession)
    thresholds, measured = {}, {}
    for kind, name in enumerate(KINDS):
        rated = sorted(((r.p, r.label) for r in held if r.kind == kind), reverse=True)
        good, best, right, taken = 0.0, None, 0.0, 0
        for k, (p, y) in enumerate(rated, 1):
            good += y
            if p >= 0.5 and good >= precision * k and (k == len(rated) or rated[k][0] < p):
                best, right, taken = p, good, k
        thresholds[kind] = float("inf") if best is None else best
        measured[name] = (right / taken if taken else 0.0, right / good if good else 0.0)
    return Booster(score, thresholds, measured, model)


# ---- the operator ------------------------------------------------------------------------------


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _clusters(spans: Column) -> Column:
    """Spans sorted by start, in arrays of those that hang together by overlaps."""
    reach = _before(spans, lambda x: x["end"], lambda a, b: F.greatest(a, b))
    first = F.filter(F.transform(F.arrays_zip(spans.alias("s"), reach.alias("r")), lambda x, i: F.when(x["s"]["start"] >= x["r"], i + 1)), lambda i: i.isNotNull())
    upto = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(F.size(spans) + 1))
    return F.zip_with(first, upto, lambda a, b: F.slice(spans, a, b - a))


def locate(docs: DataFrame, booster: Booster) -> DataFrame:
    """row, text, base and spans; see `find`."""
    three = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    limits = F.array(*[F.lit(float(booster.thresholds[k])) for k in range(len(KINDS))])

    def better(o: Column, c: Column) -> Column:
        place = lambda x: F.struct(x["start"], x["end"], x["kind"])
        return ~o["base"] & _overlap(o, c) & ((o["score"] > c["score"]) | ((o["score"] == c["score"]) & (place(o) < place(c))))

    rated = lambda c, score, base: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), F.lit(base).alias("base"), score.alias("score"))
    df = candidates(docs)
    df = df.select("row", "text", F.sort_array(F.transform(F.filter("candidates", lambda c: c["base"]), three)).alias("base"), F.filter("candidates", lambda c: ~c["base"]).alias("more"))
    df = df.withColumn("more", F.transform("more", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), features(c).alias("f"))))
    df = df.withColumn("more", F.expr(f"transform(more, c -> struct(c.kind as kind, c.start as start, c.end as end, transform(array(c.f), f -> {booster.score})[0] as score))"))
    df = df.withColumn("more", F.filter("more", lambda c: c["score"] >= F.get(limits, c["kind"])))
    # what overlaps a base span goes, then what overlaps a better candidate; both only within a cluster
    every = F.array_sort(F.concat(F.transform("base", lambda b: rated(b, F.lit(2.0), True)), F.transform("more", lambda c: rated(c, c["score"], False))))
    df = df.withColumn("every", F.when(F.size("more") > 0, every).otherwise(F.slice(every, 1, 0)))
    free = lambda cluster: F.filter(cluster, lambda c: c["base"] | ~F.exists(cluster, lambda b: b["base"] & _overlap(b, c)))
    best = lambda cluster: F.filter(cluster, lambda c: c["base"] | ~F.exists(cluster, lambda o: better(o, c)))
    df = df.withColumn("every", F.transform(_clusters(F.col("every")), free)).withColumn("every", F.flatten(F.transform("every", best)))
    spans = F.when(F.size("more") > 0, F.sort_array(F.transform("every", three))).otherwise(F.col("base"))
    # always true, but not for the optimiser: a filter on spans would else be pushed down with all of the above
    # written out in it, time and again
    return df.select("row", "text", "base", F.when(F.rand(0) < 2, spans).alias("spans"))


def find(docs: DataFrame, booster: Booster | None = None) -> DataFrame:
    """doc_id, text, base and spans: arrays of (kind number, start, end) in code points, end
    exclusive, sorted by kind, then start. Spans are the base ones and those candidates whose score
    reaches their kind's threshold and that overlap no base span and no better candidate.

    Null counts as empty and has no spans. Texts are read whole, however long; of candidates with equal
    scores the first by place is kept. Every row is handled alone: nothing is shuffled but the few rows of
    the fit, and repeated rows give equal rows. Other columns are ignored, whatever their names. An empty
    table gives none.
    """
    docs = bare(docs, "text")
    return locate(docs, booster or fit(docs)).select("row.doc_id", "text", "base", "spans")


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    # one parameter only: F.filter hands an item's index to a second one, whatever its default
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, booster: Booster | None = None) -> DataFrame:
    """docs with each span of text replaced by [KIND]; of spans that overlap, the first one's tag
    stands for all, the lower kind's where two begin and end alike. Null texts stay null; very long texts and those with many spans are rewritten
    whole; repeated rows are rewritten alike; an empty table stays empty; other columns pass through."""
    df = locate(docs, booster or fit(bare(docs, "text")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    one = lambda c: F.struct(F.element_at(c, 1)["start"].alias("start"), F.array_max(F.transform(c, lambda s: s["end"])).alias("end"), F.element_at(c, 1)["kind"].alias("kind"))
    df = df.withColumn("by_place", by_place).withColumn("runs", F.transform(_clusters(F.col("by_place")), one))
    df = df.withColumn("runs", F.zip_with("runs", _before(F.col("runs"), lambda r: r["end"], lambda a, b: b), lambda r, at: F.struct(at.alias("at"), r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind"))))

    # a text's characters are counted from its start, so a block of runs is cut out first, then its pieces
    def pieces_of(block: Column) -> Column:
        low = F.element_at(block, 1)["at"]
        part = F.array(F.substring("text", low + 1, F.element_at(block, -1)["end"] - low))
        return F.flatten(F.transform(part, lambda text: F.transform(block, lambda r: F.concat(F.substring(text, r["at"] - low + 1, r["start"] - r["at"]), F.get(names, r["kind"])))))

    rest = F.substring("text", F.element_at("runs", -1)["end"] + 1, F.length("text"))
    done = F.concat(F.array_join(F.flatten(F.transform(_blocks(F.col("runs")), pieces_of)), ""), rest)
    new = F.when(F.size("spans") > 0, done).otherwise(F.col("row.text"))
    return df.select(*[new.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
