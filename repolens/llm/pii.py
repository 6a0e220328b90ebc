"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base spans (e-mail and IP addresses, card and phone numbers in their plain forms) always stay. Generators of high recall propose further spans: obfuscated addresses, numbers without a country code, cards with other separators, IPv6. Boosted trees over format and context features score these; those above a threshold calibrated for each kind are added, from the highest score on, unless they overlap a base span or one added before. Spans are placed and chosen in time that grows with a text's length, up to the square root of its matches.

No table holds labels of such spans. The trees are trained on synthetic examples (examples()): formats in sentences against numbers that look alike (dates, versions, order numbers, prices). Their features come from the same Column expressions that run over documents. Trees and thresholds are part of the plan.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, boost, calibrate

KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns. Loops are possessive where what follows can't need what they took: Java then neither recurses nor backtracks. An e-mail's local part begins where no earlier part of it could; \G is the end of the match before.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: kind, pattern, and a cheap pattern without which a text has no match.
GENERATORS = (
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[(\[{] ?at ?[)\]}] ?[a-z0-9-]++(?: ?(?:[(\[{] ?dot ?[)\]}]|\.) ?[a-z0-9-]++)++", r"(?i)[(\[{] ?at ?[)\]}]"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ (?:at|AT) [A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)++", r" (?:at|AT) [A-Za-z0-9-]+ (?:dot|DOT) "),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"),
    ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)?(?![0-9A-Za-z:])", r"[0-9A-Fa-f]::"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])", r"[0-9] ?[\[( ]\.[\]) ]"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[./_ -]{1,3}[0-9]{4}){3}(?![0-9])", r"[0-9]{4}[./_ -]{1,3}[0-9]{4}[./_ -]"),
    ("phone", r"(?<![0-9+.])(?:\([0-9]{2,5}\)|00[0-9]{1,3}|[0-9]{2,5})[ ./-]{1,2}[0-9]{2,5}(?:[ ./-][0-9]{2,5}){1,4}(?![0-9])", r"[0-9)][ ./-]{1,2}[0-9]{2}"),
)
#: Fixed words that speak for a kind just before a span, and words that speak against all.
CONTEXT = {
    "email": "mail|contact|write|reach|address",
    "ip": r"\bip\b|address|host|server|client|from",
    "card": "card|visa|master|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|cell|fax|dial|whatsapp|sms",
}
AGAINST = r"order|invoice|isbn|version|\bdate|\bid\b|\bno\b|ref|total|price|page|serial|build|section|since|born|between"
FEATURES = ("kind", "digits", "length", "luhn", "for", "against", "glued_before", "glued_after", "groups", "longest_group", "date", "domain_end", "marked", "leads_00_or_bracket", "kinds_of_separator")


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


SPAN = "struct<s:int,e:int,m:string,b:string,a:string>"


def scan(items: Column, start: Column, step, out: str) -> Column:
    """An output (of type out) of each item of an array: step(state, item) -> struct(state, out), from left to right.

    An aggregate that appends to an array copies it each time. So items go in blocks of about the square root of their number: outputs are appended to a block's array, and blocks to an array of blocks.
    """
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda k: F.slice(items, k * size + 1, size))
    none = F.array().cast(f"array<{out}>")

    def one(acc: Column, x: Column) -> Column:
        both = F.transform(F.array(step(acc["state"], x)), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))
        return both[0]

    def block(acc: Column, items: Column) -> Column:
        # The block before is put away while this one is made from its last state.
        new = F.aggregate(items, F.struct(acc["now"]["state"].alias("state"), none.alias("outs")), one)
        return F.struct(new.alias("now"), F.concat(acc["blocks"], F.array(acc["now"]["outs"])).alias("blocks"))

    first = F.struct(F.struct(start.alias("state"), none.alias("outs")).alias("now"), F.array().cast(f"array<array<{out}>>").alias("blocks"))
    return F.when(F.size(items) > 0, F.aggregate(blocks, first, block, lambda acc: F.flatten(F.concat(acc["blocks"], F.array(acc["now"]["outs"]))))).otherwise(none)


def matches(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches with what stands around them: s, e (code points), m, b (24 characters before), a (8 after). The pieces between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if guard is not None:
        found = F.when(guard, found).otherwise(_empty("string"))

    def placed(m: Column) -> Column:
        def step(at: Column, x: Column) -> Column:
            s = at + F.char_length(x["p"])
            e = s + F.char_length(x["m"])
            span = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), F.right(x["p"], F.lit(24)).alias("b"), F.left(x["n"], F.lit(8)).alias("a"))
            return F.struct(e.alias("state"), span.alias("out"))

        # One pass sees pieces and matches once: (piece before, match, piece after).
        def rows(pieces: Column) -> Column:
            return F.zip_with(F.arrays_zip(F.slice(pieces, 1, F.size(m)).alias("p"), m.alias("m")), F.slice(pieces, 2, F.size(m)), lambda x, n: F.struct(x["p"].alias("p"), x["m"].alias("m"), n.alias("n")))

        return scan_once(rows(F.split(text, pattern, -1)), F.lit(0), step, SPAN)

    return F.when(F.size(found) > 0, F.transform(F.array(found), placed)[0]).otherwise(_empty(SPAN))


def scan_once(items: Column, start: Column, step, out: str) -> Column:
    """scan() of an array that is computed once: a variable of a lambda stands for it."""
    return F.transform(F.array(items), lambda x: scan(x, start, step, out))[0]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether a text's digits pass Luhn's check."""
    d = digits(m)

    def worth(i: Column) -> Column:
        x = F.substring(d, -i, F.lit(1)).cast("int")
        twice = x * 2
        return F.when(i % 2 == 1, x).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(d))), F.lit(0), lambda acc, i: acc + F.coalesce(worth(i), F.lit(0)))
    return (F.char_length(d) > 0) & (total % 10 == 0)


OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def holds(kind: str, m: Column) -> Column:
    """The check that a base match must pass."""
    n = F.char_length(digits(m))
    return {"email": F.lit(True), "ip": m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "card": F.when(n.between(12, 19), luhn(m)).otherwise(False), "phone": n.between(9, 15)}[kind]


def base_spans(text: Column, kind: str) -> Column:
    guard = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")}[kind]
    return F.filter(matches(text, BASE[kind], guard), lambda x: holds(kind, x["m"]))


def features(kind: str, x: Column) -> list[Column]:
    """Features of a proposed span, as whole numbers, in the order of FEATURES."""
    m, d, low = x["m"], digits(x["m"]), F.lower(x["b"])
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    return [
        F.lit(KINDS.index(kind)),
        F.char_length(d),
        F.char_length(m),
        yes(luhn(m)),
        yes(low.rlike(CONTEXT[kind])),
        yes(low.rlike(AGAINST)),
        yes(x["b"].rlike(r"[A-Za-z0-9_$€£#/.-]$")),
        yes(x["a"].rlike(r"^(?:[A-Za-z0-9_%€$]|[.,:/-][0-9])")),
        F.size(groups),
        F.coalesce(F.array_max(F.transform(groups, lambda g: F.char_length(g))), F.lit(0)),
        yes(m.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)") & m.rlike(r"^[0-9]{1,4}[-./ ][0-9]{1,2}[-./ ][0-9]{1,4}")),
        yes(m.rlike(r"(?i)(?:com|org|net|edu|gov|io|info|co|uk|de|fr|es|it|eu)$")),
        yes(m.rlike(r"(?i)[(\[{] ?(?:at|dot) ?[)\]}]|[\[(]\.[\])]|::")),
        yes(m.rlike(r"^(?:00|\()")),
        F.size(F.array_distinct(F.regexp_extract_all(m, F.lit("[ ./_-]"), F.lit(0)))),
    ]


def examples(n: int = 200, seed: int = 17) -> list[tuple[str, str, str, str, int]]:
    """Synthetic proposals (kind, before, match, after, label), n of each form."""
    rng, out = random.Random(seed), []
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(3, 9)))

    def card() -> str:
        body = number(15)
        total = sum(int(c) if i % 2 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(body))
        return body + str(-total % 10)

    def add(kind: str, cues: list[str], m: str, label: int) -> None:
        cue = rng.choice(cues) if rng.random() < 0.6 else ""
        before = f"{word()} {word()} {cue}".strip() + rng.choice([" ", ": ", " "])
        out.append((kind, before[-24:], m, rng.choice([" ", ".", ",", ""]) + word()[:4] if rng.random() < 0.8 else "", label))

    reach, odd = ["mail me", "contact", "write to", "reach"], ["order no", "invoice", "version", "date", "ref", "total", "page", "serial", "isbn", "section"]
    for _ in range(n):
        at, dot = rng.choice([("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), ("(At)", "."), (" ( at ) ", " ( dot ) "), ("{AT}", "{DOT}")])
        add("email", reach, f"{word()}.{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}", 1)
        add("email", reach, f"{word()} {(how := rng.choice([str, str, str.upper]))('at')} {word()} {how('dot')} {rng.choice(['com', 'org', 'net'])}", 1)
        add("email", ["stay", "look", "arrive"], f"{word()} at {word()} dot {word()}", 0)
        add("email", ["see", "note"], f"{word()} (at) {word()}. {word()}", 0)
        add("ip", ["ip", "host", "server"], ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8)), 1)
        part = lambda k: ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(k))
        add("ip", ["ip", "host", "server"], rng.choice([f"{part(rng.randint(1, 4))}::{part(rng.randint(1, 3))}", f"{part(rng.randint(1, 4))}::"]), 1)
        add("ip", ["see", "call"], f"{rng.choice(['add', 'Face', 'be', 'cafe', 'a', 'dad'])}::{rng.choice(['add', 'bed', 'fade', 'c', ''])}", 0)
        add("ip", ["ip", "host", "server"], rng.choice(["[.]", "(.)"]).join(str(rng.randrange(256)) for _ in range(4)), 1)
        add("ip", odd, " . ".join(str(rng.randrange(999)) for _ in range(4)), 0)
        add("ip", odd, ":".join(number(2) for _ in range(8)), 0)
        c, sep = card(), rng.choice([".", "/", "_", " - ", "  ", "-"])
        add("card", ["card", "visa", "credit card", "payment"], sep.join(c[k : k + 4] for k in range(0, 16, 4)), 1)
        bad = c[:-1] + str((int(c[-1]) + rng.randint(1, 9)) % 10)
        add("card", odd, sep.join(bad[k : k + 4] for k in range(0, 16, 4)), 0)
        a, b = number(3), number(4)
        add("phone", ["call", "phone", "tel", "fax", "mobile"], rng.choice([f"({a}) {number(3)}-{b}", f"{a}-{number(3)}-{b}", f"{a} {number(3)} {b}", f"00{number(2)} {a} {b} {number(3)}", f"0{number(2)}/{b} {number(4)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}"]), 1)
        y, mo, da = str(rng.randint(1950, 2030)), f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}"
        add("phone", odd, rng.choice([f"{y}-{mo}-{da}", f"{da}.{mo}.{y}", f"{da}/{mo}/{y}", f"{number(2)}.{number(2)}.{number(2)}", f"{number(2)}-{number(2)}-{number(2)}", f"{number(5)} {number(5)} {number(5)} {number(5)}", f"{number(3)}/{number(2)}/{number(5)}", f"978-{number(2)}-{number(5)}-{number(3)}", f"{y} {number(2)} {number(2)} {y}"]), 0)
    return out


def train(spark: SparkSession, precision: float = 0.98, seed: int = 17) -> tuple[Boosted, dict[str, float]]:
    """Trees over the synthetic examples, and for each kind the threshold on the raw score that has the precision on a third of them kept apart."""
    rows = examples(seed=seed)
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, kind string, b string, m string, a string, y int")
    span = F.struct("b", "m", "a")
    of = F.array(*(F.lit(0) for _ in FEATURES))
    for kind in KINDS:
        of = F.when(F.col("kind") == kind, F.array(*features(kind, span))).otherwise(of)
    got = table.select("id", of.alias("x")).orderBy("id").collect()
    x, y, kinds = np.array([r["x"] for r in got], float), np.array([r[4] for r in rows]), np.array([r[0] for r in rows])
    apart = np.random.default_rng(seed).random(len(y)) < 1 / 3
    model = boost(x[~apart], y[~apart])
    raw = model.raw(x)
    return model, {k: calibrate(raw[apart & (kinds == k)], y[apart & (kinds == k)], precision) for k in KINDS}


ADDED = "struct<s:int,e:int,k:int,score:double>"
PLACE = "struct<s:int,k:int,e:int>"


def chosen(base: Column, proposed: Column) -> Column:
    """All base spans, and of the proposed ones those that meet neither a base span nor an added one of higher score (of equal scores: that sorts before), taken in this order. Spans (s, k, e) in no order.

    Spans in order of their starts fall into clusters: a new one begins where a span meets none before it. Only spans of a cluster are held against each other.
    """
    rank = lambda x, is_base, score: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), F.lit(is_base).alias("base"), score.alias("score"))
    spans = F.array_sort(F.concat(F.transform(base, lambda x: rank(x, True, F.lit(0.0))), F.transform(proposed, lambda x: rank(x, False, x["score"]))))
    begins = lambda end, x: F.struct(F.greatest(end, x["e"]).alias("state"), (x["s"] >= end).alias("out"))

    def greedy(cluster: Column) -> Column:
        order = F.array_sort(F.transform(cluster, lambda x: F.struct((~x["base"]).alias("o"), (-x["score"]).alias("p"), x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
        free = lambda acc, x: ~F.exists(acc, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))
        place = lambda x: F.array(F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
        return F.aggregate(order, _empty(PLACE), lambda acc, x: F.when(~x["o"] | free(acc, x), F.concat(acc, place(x))).otherwise(acc))

    def clusters(spans: Column) -> Column:
        marks = scan_once(spans, F.lit(-1), begins, "boolean")
        starts = F.filter(F.transform(marks, lambda new, i: F.when(new, i)), lambda i: i.isNotNull())
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda i, j: F.slice(spans, i + 1, F.coalesce(F.get(at, j + 1), F.size(spans)) - i)))[0]

    places = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    swept = F.transform(F.array(spans), lambda x: F.flatten(F.transform(clusters(x), greedy)))[0]
    return F.when(F.size(proposed) > 0, swept).otherwise(places(base))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98) -> DataFrame:
    """Spans of personal data in every whole text: id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    spans has all spans as kind:start:end (code points, end exclusive), by start, then by the order of KINDS, comma-joined; base_sha256 digests the base ones written so. Null texts count as empty. A row depends on its text alone: nothing is shuffled, and repeated rows, ties and null ids need no rule. An empty table gives an empty result. Other columns are not read.
    """
    model, cuts = train(docs.sparkSession, precision)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    place = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e"))
    rows = rows.select("id", "t", *(base_spans(F.col("t"), k).alias(k) for k in KINDS))
    proposed = []
    scored = lambda kind: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(kind)).alias("k"), model.raw_column(features(kind, x)).alias("score"))
    passes = lambda kind: lambda x: x["score"] >= cuts[kind]
    for kind, pattern, guard in GENERATORS:
        found = F.transform(matches(F.col("t"), pattern, F.col("t").rlike(guard)), scored(kind))
        proposed.append(F.filter(found, passes(kind)).cast(f"array<{ADDED}>"))
    rows = rows.select("id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.concat(*(F.transform(k, place(k)) for k in KINDS)).alias("base"), F.concat(*proposed).alias("proposed"))
    rows = rows.select("id", *(f"n_{k}" for k in KINDS), "base", chosen(F.col("base"), F.col("proposed")).alias("all"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select(F.col("id").alias(id_col), *(f"n_{k}" for k in KINDS), F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.col("all")).alias("spans"))
