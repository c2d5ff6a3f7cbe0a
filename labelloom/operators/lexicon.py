"""Synonym expansion and sector mapping."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions import lexicons
from labelloom.functions.arrays import empty_strings, unnest, words
from labelloom.plans.joins import lookup_join

#: Sectors in one integer.
MASK_BITS = 62


def expand_synonyms(
    df: DataFrame,
    key: str,
    terms: str,
    synonyms: DataFrame = None,
    name: str = "synonyms",
    looked_up: int = 5,
    synsets: int = 2,
    lemmas: int = 3,
    added: int = 10,
) -> DataFrame:
    """``df`` with the terms followed by new synonyms in lexicon order.

    Phrases are kept but not looked up.  The four limits are those of the
    optimized mode; ``None`` lifts a limit.
    """
    if synonyms is None:
        return df.withColumn(name, F.col(terms))
    single = (
        unnest(df, [key], F.col(terms), "term", pos="pos")
        .where(~F.contains("term", F.lit(" ")))
    )
    if looked_up is not None:
        single = single.where(F.col("pos") < looked_up)
    lexicon = synonyms.withColumn("lemma", F.replace("lemma", F.lit("_"), F.lit(" ")))
    lexicon = lexicon.where(F.col("lemma") != F.col("term"))
    if synsets is not None:
        lexicon = lexicon.where(F.col("synset_rank") <= synsets)
    if lemmas is not None:
        lexicon = lexicon.where(F.col("lemma_rank") <= lemmas)
    found = lookup_join(single, lexicon, ["term"], spread=key)
    ordered = found.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "synset_rank", "lemma_rank", "lemma"))
        ).alias("_found")
    )
    # array_except keeps first occurrences in order and drops repeats
    new = F.array_except(
        F.coalesce(F.transform("_found", lambda s: s["lemma"]), empty_strings()),
        F.col(terms),
    )
    if added is not None:
        new = F.slice(new, 1, added)
    return (
        df.join(ordered, key, "left")
        .withColumn(name, F.concat(terms, new))
        .drop("_found")
    )


def expand_synonyms_full(
    df: DataFrame, key: str, terms: str, synonyms: DataFrame = None, name: str = "synonyms"
) -> DataFrame:
    return expand_synonyms(
        df, key, terms, synonyms, name, looked_up=None, synsets=None, lemmas=None, added=None
    )


def _sector_tests(
    df: DataFrame, column: str, mode: str, lexicon: dict[str, list[str]]
) -> tuple[DataFrame, list[Column]]:
    """``df`` with helper columns, and whether the text has each sector.

    Optimized: a one-word keyword must be a word of the text, a phrase a
    substring.  Basic: any keyword as a substring.
    """
    if mode not in ("optimized", "basic"):
        raise ValueError(f"Unknown mode: {mode}")
    by_word = {
        s: [k for k in ks if mode == "optimized" and " " not in k]
        for s, ks in lexicon.items()
    }
    single = sorted({k for ks in by_word.values() for k in ks})
    out = df.withColumn("_text", F.lower(F.coalesce(F.col(column), F.lit(""))))
    # one pass over the words leaves the few that are keywords
    out = out.withColumn(
        "_hits",
        F.array_intersect(words(F.col("_text")), F.array(*map(F.lit, single)))
        if single else empty_strings(),
    )

    def matches(sector: str) -> Column:
        tests = [F.contains("_text", F.lit(k)) for k in lexicon[sector] if k not in by_word[sector]]
        if by_word[sector]:
            tests.insert(0, F.arrays_overlap("_hits", F.array(*map(F.lit, by_word[sector]))))
        return reduce(or_, tests, F.lit(False))

    return out, [matches(s) for s in lexicon]


def with_sectors(
    df: DataFrame,
    column: str,
    name: str = "insurance_sectors",
    mode: str = "optimized",
    lexicon: dict[str, list[str]] = None,
) -> DataFrame:
    """Sectors with a keyword in the text, in lexicon order."""
    lexicon = lexicons.SECTOR_KEYWORDS if lexicon is None else lexicon
    out, found = _sector_tests(df, column, mode, lexicon)
    named = F.array(*[F.when(f, F.lit(s)) for s, f in zip(lexicon, found)])
    return out.withColumn(name, F.filter(named, lambda s: s.isNotNull())).drop("_text", "_hits")


def with_sector_masks(
    df: DataFrame,
    column: str,
    name: str = "sector_masks",
    mode: str = "optimized",
    lexicon: dict[str, list[str]] = None,
) -> DataFrame:
    """The sectors of the text as bits, in lexicon order: an array with one
    integer per ``MASK_BITS`` sectors, so that any lexicon fits."""
    lexicon = lexicons.SECTOR_KEYWORDS if lexicon is None else lexicon
    out, found = _sector_tests(df, column, mode, lexicon)
    masks = [
        reduce(add, [F.when(f, F.lit(1 << i)).otherwise(0).cast("bigint") for i, f in enumerate(found[at : at + MASK_BITS])])
        for at in range(0, len(found), MASK_BITS)
    ]
    return out.withColumn(name, F.array(*masks) if masks else F.array(F.lit(0).cast("bigint"))).drop("_text", "_hits")


def mask_bits(masks: Column) -> Column:
    """Numbers of the sectors that are set."""
    def of(mask: Column, at: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(MASK_BITS - 1))
        return F.transform(F.filter(numbers, lambda i: F.getbit(mask, i) == 1), lambda i: i + at * MASK_BITS)

    return F.flatten(F.transform(masks, of))


def mask_key(masks: Column) -> Column:
    """Text of a set of sectors for equality; empty for the empty set."""
    some = F.exists(masks, lambda m: m != 0)
    return F.when(some, F.array_join(F.transform(masks, lambda m: m.cast("string")), ",")).otherwise("")


def jaccard(a: Column, b: Column) -> Column:
    """Common bits over all bits of two sets of sectors; null for two empty ones."""
    def total(both: Column) -> Column:
        return F.aggregate(both, F.lit(0), lambda n, m: n + F.bit_count(m))

    every = total(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    common = total(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    return F.when(every > 0, common / every)


def sector_table(spark, lexicon: dict[str, list[str]] = None) -> DataFrame:
    """The sector lexicon as rows ``(sector, pos, keyword)``."""
    lexicon = lexicons.SECTOR_KEYWORDS if lexicon is None else lexicon
    rows = [
        (s, i, p, k)
        for i, (s, ks) in enumerate(lexicon.items())
        for p, k in enumerate(ks)
    ]
    return spark.createDataFrame(rows, "sector string, sector_pos int, pos int, keyword string")
