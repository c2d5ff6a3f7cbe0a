"""Quality rules: a decision list learned by sequential covering.

Text statistics are built-in expressions.  Rules are conjunctions of threshold
conditions on those statistics.  A rule is grown condition by condition on two
thirds of the labelled rows (FOIL gain), pruned on the last third, and kept only
if it is precise on both; the rows it covers are removed and the next rule is
grown.  The learner sees counts per statistic and cut only: every step is one
aggregation over all labelled rows, and the driver gets at most
``len(CUTS) * 30`` rows of counts.  The list becomes ordered ``when`` clauses.

Nulls and edges: a null text has no words.  Labels without a quality or doc_id
are not used; a document with several labels counts once for each.  Without
labels, or without rejected ones, the list is empty and only the base rule
rejects.
"""

from __future__ import annotations

import math
import operator
import re
import string
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.common import count_chars, let, words
from labelloom.plans.joins import fits_broadcast
from labelloom.plans.scratch import materialize

SYMBOLS = "#*$%&|<>"
#: Kinds of characters that are counted, all ASCII.
COUNTED = {
    "symbols": SYMBOLS,
    "capitals": string.ascii_uppercase,
    "digits": string.digits,
    "marks": ".,;:!?",
    "shouts": "!",
}
_NOT_COUNTED = "[^" + re.escape("".join(dict.fromkeys("".join(COUNTED.values())))) + "]++"
_WORD_CHAR = r"[^\x20\x09-\x0D]"
WINDOW = 5
#: Ids of labelled documents that may be broadcast (16 MB as numbers).
LABELLED = 2_000_000
_SHARE = [0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]

#: Statistic -> candidate thresholds.
CUTS = {
    "words_total": [5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000],
    "word_length": [1, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 9, 10, 12, 15, 20],
    "symbols_per_word": [*_SHARE, 1, 1.5, 2, 3],
    "capitals": _SHARE,
    "digits": _SHARE,
    "punctuation": _SHARE,
    "exclamations": _SHARE,
    "duplicate_lines": _SHARE,
    "repeated_words": _SHARE,
    "distinct_words": _SHARE,
    "words_per_line": [1, 2, 3, 5, 8, 12, 20, 30, 50, 100, 200],
}


def _repeated_words(w: Column) -> Column:
    """Words inside a window of WINDOW words that the text holds twice or more."""

    def positions(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
            | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
            F.lit(0),
            lambda a, x: a + x,
        )

    def repeated(keys: Column) -> Column:
        placed = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        # most texts hold no window twice and need no sort
        once = F.size(F.array_distinct(keys)) == F.size(keys)
        return F.when(once, 0).otherwise(let(let(F.sort_array(placed), positions), covered))

    def windows(h: Column) -> Column:
        keys = F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]),
        )
        return let(keys, repeated)

    return F.when(F.size(w) > WINDOW, let(F.transform(w, lambda x: F.xxhash64(x)), windows)).otherwise(0)


def statistics(text: Column) -> Column:
    """Counts and learned-rule statistics of a whole text, as one struct."""
    text = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup")
        )

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("words"),
            F.size(F.array_distinct(w)).alias("distinct"),
            _repeated_words(w).alias("repeat"),
            F.length(F.array_join(w, "")).alias("chars"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD_CHAR))

    def of_marks(marks: Column) -> Column:
        return F.struct(*[count_chars(marks, chars).alias(name) for name, chars in COUNTED.items()])

    def build(x: Column) -> Column:
        n = x["w"]["words"]
        per_word = lambda c: c / F.greatest(n, F.lit(1))
        chars = x["w"]["chars"]
        per_char = lambda c: c / F.greatest(chars, F.lit(1))
        return F.struct(
            n.cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            x["m"]["symbols"].cast("long").alias("n_symbols"),
            x["l"]["dup"].cast("long").alias("n_dup_lines"),
            x["w"]["repeat"].cast("long").alias("n_repeat_words"),
            n.cast("double").alias("words_total"),
            per_word(chars).alias("word_length"),
            per_word(x["m"]["symbols"]).alias("symbols_per_word"),
            per_char(x["m"]["capitals"]).alias("capitals"),
            per_char(x["m"]["digits"]).alias("digits"),
            per_char(x["m"]["marks"]).alias("punctuation"),
            per_word(x["m"]["shouts"]).alias("exclamations"),
            (x["l"]["dup"] / F.greatest(x["l"]["lines"], F.lit(1))).alias("duplicate_lines"),
            per_word(x["w"]["repeat"]).alias("repeated_words"),
            per_word(x["w"]["distinct"]).alias("distinct_words"),
            (n / F.greatest(x["l"]["lines"], F.lit(1))).alias("words_per_line"),
        )

    return let(
        F.struct(
            let(words(text), of_words).alias("w"),
            let(lines, of_lines).alias("l"),
            # the few characters that are counted; a translation looks up every one
            let(F.regexp_replace(text, _NOT_COUNTED, ""), of_marks).alias("m"),
        ),
        build,
    )


def base_failed(s: Column) -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    cut: float

    def column(self, s: Column) -> Column:
        return s[self.statistic] > self.cut if self.above else s[self.statistic] <= self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.cut:g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, otherwise a text is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def first_rule(self, s: Column) -> Column:
        """Number of the first rule that holds, or null."""
        clauses = F
        for i, rule in enumerate(self.rules):
            clauses = clauses.when(_all(rule, s), F.lit(i))
        return F.lit(None).cast("int") if clauses is F else clauses

    def kept(self, s: Column) -> Column:
        return ~base_failed(s) & self.first_rule(s).isNull()

    def __str__(self) -> str:
        return "\n".join(["reject if " + " and ".join(map(str, r)) for r in self.rules] + ["otherwise keep"])


def _all(rule, s: Column) -> Column:
    return reduce(operator.and_, [c.column(s) for c in rule], F.lit(True))


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: value > c))


def _bad(x: Column) -> Column:
    return F.sum(x.cast("long"))


def fit(
    labelled: DataFrame,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_precision: float = 0.95,
    min_cover: int = 10,
) -> DecisionList:
    """A decision list for ``labelled`` (doc_id, s: statistics, quality 0/1)."""
    bins = [_bin(F.col("s")[k], cuts) for k, cuts in CUTS.items()]
    rows = materialize(
        labelled.where(F.col("quality").isNotNull() & ~base_failed(F.col("s"))).select(
            (F.col("quality") == 0).alias("bad"),
            (F.crc32(F.col("doc_id").cast("string")) % 3 == 2).alias("held"),
            F.struct(*[F.col("s")[k].alias(k) for k in CUTS]).alias("s"),
            F.array(*bins).alias("bins"),
        ),
        "labelled",
    )
    names, found = list(CUTS), DecisionList()
    s = F.col("s")
    open_rows = F.lit(True)
    while len(found.rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            seen = (
                rows.where(~F.col("held") & open_rows & _all(rule, s))
                .select("bad", F.posexplode("bins").alias("stat", "bin"))
                .groupBy("stat", "bin")
                .agg(_bad(F.col("bad")).alias("bad"), F.count(F.lit(1)).alias("n"))
                .collect()
            )
            best = _best(seen, names, min_cover)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        prefixes = [
            [_bad(F.col("bad") & F.col("held") & _all(rule[: k + 1], s)).alias(f"held_bad{k}"),
             _bad(F.col("held") & _all(rule[: k + 1], s)).alias(f"held{k}"),
             _bad(F.col("bad") & _all(rule[: k + 1], s)).alias(f"bad{k}"),
             _bad(_all(rule[: k + 1], s)).alias(f"all{k}")]
            for k in range(len(rule))
        ]
        got = rows.where(open_rows).agg(*sum(prefixes, [])).first()
        sized = [(got[f"held_bad{k}"] or 0, got[f"held{k}"] or 0) for k in range(len(rule))]
        worth = [(2 * p - n) / n if n else -1.0 for p, n in sized]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        cover, hit = got[f"all{k}"] or 0, got[f"bad{k}"] or 0
        if cover < min_cover or hit < min_precision * cover or sized[k][0] < min_precision * sized[k][1]:
            break
        found.rules.append(tuple(rule[: k + 1]))
        open_rows = open_rows & ~_all(rule[: k + 1], s)
    return found


def _best(seen, names, min_cover: int) -> Condition | None:
    """The condition of the highest FOIL gain over counts by statistic and bin."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in seen:
        by.setdefault(r["stat"], {})[r["bin"]] = (r["bad"] or 0, r["n"])
    best, gain = None, 1e-9
    for stat in sorted(by):
        p0, n0 = (sum(x) for x in zip(*by[stat].values(), strict=True))
        if not p0 or p0 == n0:
            return None
        p = n = 0
        for i, cut in enumerate(CUTS[names[stat]]):
            more = by[stat].get(i, (0, 0))
            p, n = p + more[0], n + more[1]
            for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                if a < min_cover // 2 or b == n0:
                    continue
                g = a * (math.log2(a / b) - math.log2(p0 / n0))
                if g > gain * (1 + 1e-12):
                    best, gain = Condition(names[stat], above, float(cut)), g
    return best


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, s and quality of the labelled documents.

    While the labelled ids can be broadcast, only their texts are measured; beyond
    that the statistics of all are made before the join, so that small rows are
    shuffled and not the texts."""
    marks = labels.select("doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL")
    ids = marks.select("doc_id").distinct()
    if fits_broadcast(ids, rows=LABELLED):
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.select("doc_id", statistics(F.col("text")).alias("s")).join(marks, "doc_id").select("doc_id", "quality", "s")
