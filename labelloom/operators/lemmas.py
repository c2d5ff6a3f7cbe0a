"""Noun lemmas by rules, checked against a lexicon's index.

A surface form is tried as it is and with one suffix detached; if the index knows
none of these forms, suffixes are detached from the results again, until it does
or no rule applies.  A form of the exception table is tried with its listed lemmas
only.  Of the known forms the shortest is the lemma, the earlier rule on ties; a
form without any stays as it is.

All candidates of all distinct surface forms are checked by one join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions.arrays import unnest, words
from labelloom.operators.features import lemmatize, require_columns
from labelloom.plans.joins import lookup_join
from labelloom.plans.scratch import materialize

# Ending of a plural noun and what it becomes, in order.
NOUN_ENDINGS = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]
_CANDIDATES = "array<struct<level:int,place:int,form:string>>"


@dataclass(frozen=True)
class LemmaRules:
    """``index`` holds the known ``lemma``s, ``exceptions`` rows ``(surface, rank, lemma)``."""

    index: DataFrame
    exceptions: DataFrame = None


def detached(form: Column) -> Column:
    """The forms that one rule makes of ``form``, in the order of the rules."""
    made = [
        F.when(F.endswith(form, F.lit(end)), F.concat(F.substring(form, F.lit(1), F.length(form) - len(end)), F.lit(new)))
        for end, new in NOUN_ENDINGS
    ]
    return F.filter(F.array(*made), lambda f: f.isNotNull())


def _at_level(forms: Column, level: Column) -> Column:
    return F.transform(
        forms, lambda f, i: F.struct(level.cast("int").alias("level"), i.cast("int").alias("place"), f.alias("form"))
    ).cast(_CANDIDATES)


def candidates(surface: Column) -> Column:
    """``(level, place, form)``: level 0 is the surface and what one rule makes of
    it, every further level what the rules make of the forms before."""
    first = detached(surface)
    start = F.struct(
        first.alias("forms"), _at_level(F.concat(F.array(surface), first), F.lit(0)).alias("found")
    )

    def again(state: Column, level: Column) -> Column:
        forms = F.flatten(F.transform(state["forms"], detached))
        return F.struct(forms.alias("forms"), F.concat(state["found"], _at_level(forms, level)).alias("found"))

    # no rule makes a form longer, and only one that no other follows keeps its length
    rounds = F.sequence(F.lit(1), F.greatest(F.length(surface), F.lit(1)))
    return F.when(F.size(first) > 0, F.aggregate(rounds, start, again)["found"]).otherwise(start["found"])


def noun_lemmas(surfaces: DataFrame, rules: LemmaRules) -> DataFrame:
    """``(surface, lemma)`` of the distinct ``surfaces`` whose lemma is another form."""
    require_columns(surfaces, "surface")
    tried = candidates(F.col("surface"))
    forms = surfaces.select("surface").distinct()
    if rules.exceptions is None:
        forms = forms.select("surface", F.inline(tried))
    else:
        listed = rules.exceptions.groupBy("surface").agg(F.sort_array(F.collect_list(F.struct("rank", "lemma"))).alias("_listed"))
        own = F.concat(F.array("surface"), F.transform("_listed", lambda x: x["lemma"]))
        forms = lookup_join(forms, listed, ["surface"], spread="surface", how="left").select(
            "surface", F.inline(F.when(F.col("_listed").isNotNull(), _at_level(own, F.lit(0))).otherwise(tried))
        )
    known = rules.index.select(F.col("lemma").alias("form")).where("form <> ''").distinct()
    valid = lookup_join(forms, known, ["form"], spread="surface")
    best = F.min(F.struct("level", F.length("form").alias("size"), "place", "form"))["form"]
    return valid.groupBy("surface").agg(best.alias("lemma")).where("lemma <> surface")


def lemmatize_by_rules(df: DataFrame, key: str, columns: list[str], rules: LemmaRules) -> DataFrame:
    """Every token of the (cleaned) columns replaced by its noun lemma."""
    require_columns(df, key, *columns)
    surfaces = df.select(F.explode(F.flatten(F.array(*[words(F.col(c)) for c in columns]))).alias("surface"))
    table = materialize(noun_lemmas(surfaces, rules), "lemmas")
    return lemmatize(df, key, columns, table)
