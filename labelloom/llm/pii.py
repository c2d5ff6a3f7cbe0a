"""Personal data: patterns propose spans, checksums and nearby words decide.

Every kind has a pattern, a check (octets, Luhn, mod-97, number of digits), a
score for a match that passes it and words that raise the score when they stand
shortly before the match.  A kind whose score alone is below the threshold needs
such a word.  The four base kinds are always reported when their check passes;
the context only changes their score.

Patterns are spelled for Java: possessive quantifiers and look-behinds keep them
linear on very long runs of characters without changing what they match.
Positions are code points, ends are exclusive.

Nulls and edges: a null text is empty and has no spans; repeated rows are
scanned each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.common import let

CONTEXT = 40
THRESHOLD = 0.6
RAISE = 0.35


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A literal that every match holds; texts without it are not searched.
    needs: str | None
    score: float
    context: str


_LOCAL = "A-Za-z0-9._%+-"

# Kinds in the order that sorts spans of one start.
BASE = [
    Kind(
        "email",
        rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@", 0.9, r"\b(e-?mail|mail|contact|write)\b",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ".", 0.6, r"\b(ip|address|host|server)\b",
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
        None, 0.8, r"\b(card|visa|mastercard|credit|debit|payment)\b",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+", 0.7, r"\b(phone|tel|call|mobile|fax)\b",
    ),
]
ADDED = [
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        None, 0.9, r"\b(iban|account|bank|transfer)\b",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "-", 0.4, r"\b(ssn|social security)\b",
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
        None, 0.3, r"(token|secret|api.?key|password|passwd)\b",
    ),
]
KINDS = [*BASE, *ADDED]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""

    def total(values: Column) -> Column:
        each = F.transform(
            values, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        )
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    return let(values, total) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an IBAN passes its check: the rest by 97 is 1."""
    turned = F.concat(F.substring(code, 5, 99), F.substring(code, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(
        chars,
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise(
            (a * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return rest == 1


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0"))),
            lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        compact = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(compact).between(15, 34) & mod97(compact)
    return F.lit(True)


def _matches(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, text>> of all matches of the pattern, in order."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def place(m: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + F.length(x["gap"])
            end = begin + F.length(x["m"])
            one = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), x["m"].alias("text"))
            return F.struct(end.cast("int").alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

        pairs = F.arrays_zip(m.alias("m"), F.slice(gaps, F.lit(1), F.size(m)).alias("gap"))
        pairs = F.transform(pairs, lambda p: F.struct(p["m"].alias("m"), p["gap"].alias("gap")))
        return F.when(F.size(m) == 0, empty).otherwise(F.aggregate(pairs, start, step, lambda a: a["out"]))

    # an array of one text binds the matches once
    placed = let(found, place)
    if kind.needs:
        placed = F.when(F.instr(text, kind.needs) > 0, placed).otherwise(empty)
    return placed


def _scored(text: Column, kind: Kind):
    """Turns a match of ``kind`` into a span with its score."""

    def score(m: Column) -> Column:
        before = F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
        near = F.when(F.lower(before).rlike(kind.context), F.lit(RAISE)).otherwise(0.0)
        return F.struct(
            m["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            m["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            m["text"].alias("text"),
            F.round(F.least(F.lit(1.0), F.lit(kind.score) + near), 2).alias("score"),
        )

    return score


def _valid(kind: Kind):
    return lambda m: _passes(kind.name, m["text"])


def spans(text: Column) -> Column:
    """All accepted spans of a text in the order of start and kind:
    array<struct<start, rank, end, kind, text, score>>."""
    text = F.coalesce(text, F.lit(""))
    parts = [F.transform(F.filter(_matches(text, kind), _valid(kind)), _scored(text, kind)) for kind in BASE]
    for kind in ADDED:
        found = F.transform(F.filter(_matches(text, kind), _valid(kind)), _scored(text, kind))
        parts.append(F.filter(found, lambda s: s["score"] >= THRESHOLD))
    return F.sort_array(F.concat(*parts))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` of every document."""
    return docs.select("doc_id", spans(F.col("text")).alias("spans"))


def joined(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping
    spans the first one counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        return F.when(s["start"] < a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")
                ).alias("out"),
            )
        )

    return F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
