"""Similarities between companies and labels.

Company and label features are rows ``(kind, term)``.  One equi-join of the two
tables finds every pair that has anything in common; pairs without a common
feature never exist.  One aggregation by pair then yields all components:

``gram``     TF-IDF dot product
``word``     words of the raw label found in the company text
``syn``      common members of the synonym sets
``sectors``  the company's set of sectors, one row per company
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.functions import lexicons
from labelloom.functions.arrays import unnest, words
from labelloom.operators import lexicon as lex
from labelloom.operators import gram_norms, tfidf
from labelloom.operators.features import (
    combined_term_counts, require_columns, with_key_terms,
)
from labelloom.plans.joins import fits_broadcast, lookup_join
from labelloom.plans.scratch import materialize, materialize_bucketed, shuffle_width

KINDS = ("gram", "word", "syn", "sectors")
# one row per company, so that companies without any feature are not lost
SELF = "self"


def _feature(key: str, kind: str, term: Column, weight: Column) -> list[Column]:
    return [
        F.col(key),
        term.alias("term"),
        weight.cast("double").alias("w"),
        F.lit(kind).alias("kind"),
    ]


# --- company side ----------------------------------------------------------

def company_terms(
    df: DataFrame, key: str, text: str, mode: str, synonyms: DataFrame = None
) -> DataFrame:
    """``(key, synonyms)``: the company's terms and their synonyms, as a set."""
    terms = with_key_terms(df.select(key, text), text, mode, "terms")
    if mode == "optimized":
        terms = terms.withColumn("terms", F.slice("terms", 1, 10))
    terms = terms.select(key, "terms")
    expand = lex.expand_synonyms if mode == "optimized" else lex.expand_synonyms_full
    return expand(terms, key, "terms", synonyms).select(
        key, F.array_distinct("synonyms").alias("synonyms")
    )


def company_features(
    df: DataFrame,
    key: str,
    text: str,
    mode: str = "optimized",
    kinds: tuple[str, ...] = KINDS,
    sectors: dict[str, list[str]] = None,
    synonyms: DataFrame = None,
    repeats: dict[str, int] = None,
    wanted: DataFrame = None,
) -> DataFrame:
    """Feature rows ``(key, term, w, kind)``, written bucketed by key.

    ``wanted`` has the ``(kind, term)`` of the labels' words and synonyms; a
    company word or synonym that no label has is not written.

    With ``repeats`` the company text is the combined text of those columns:
    its n-grams are counted without building it, and the other features read
    ``text``, which then needs only as many copies as they can notice.
    """
    require_columns(df, key, text)
    width = shuffle_width(df)
    if wanted is not None:
        wanted = wanted.select("kind", "term").distinct()
    small = wanted is not None and fits_broadcast(wanted)

    def useful(rows: DataFrame) -> DataFrame:
        if wanted is None:
            return rows
        if small:
            return rows.join(F.broadcast(wanted), ["kind", "term"], "left_semi")
        # a large taxonomy: salted by shuffle, then back to the key's bucket
        found = lookup_join(rows, wanted, ["kind", "term"], spread=key)
        return found.repartition(width, key)

    columns = list(dict.fromkeys([key, text, *(repeats or {})]))
    spread = df.select(*columns).repartition(width, key)
    if len(kinds) > 1:
        # the cleaned texts are read once per kind, so they are written first
        spread = materialize_bucketed(spread, "texts", key, width)
    parts = [spread.select(*_feature(key, SELF, F.lit(""), F.lit(0)))]
    if "gram" in kinds:
        counts = (
            combined_term_counts(spread, key, repeats)
            if repeats else tfidf.term_counts(spread, key, text)
        )
        parts.append(
            counts.select(*_feature(key, "gram", F.col("term"), tfidf.sublinear(F.col("tf"))))
        )
    if "word" in kinds:
        distinct = F.array_distinct(words(F.lower(text)))
        parts.append(
            useful(
                unnest(spread, [key], distinct, "term")
                .select(*_feature(key, "word", F.col("term"), F.lit(1)))
            )
        )
    if "syn" in kinds:
        sets = company_terms(spread, key, text, mode, synonyms)
        parts.append(
            useful(
                unnest(sets, [key, F.size("synonyms").alias("n")], F.col("synonyms"), "term")
                .select(*_feature(key, "syn", F.col("term"), F.col("n")))
            )
        )
    if "sectors" in kinds:
        mapped = lex.with_sector_masks(spread.select(key, text), text, "s", mode, sectors)
        parts.append(
            mapped.select(*_feature(key, "sectors", lex.mask_key(F.col("s")), F.lit(1)))
            .where(F.col("term") != "")
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return materialize_bucketed(rows, "features", key, width)


def shared_features(texts: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """Rows ``(key, term, w, kind)`` of ``gram_norms.key_texts`` as ``company_features``
    has them, but of n-grams only those that are one of ``terms``, and a few others."""
    own = unnest(texts, [key], F.array_repeat(F.lit(""), F.col("rows").cast("int")), "term")
    grams = gram_norms.shared_counts(texts, key, terms)
    rows = own.select(*_feature(key, SELF, F.col("term"), F.lit(0))).unionByName(
        grams.select(*_feature(key, "gram", F.col("term"), tfidf.sublinear(F.col("tf"))))
    )
    width = shuffle_width(texts)
    return materialize_bucketed(rows.repartition(width, key), "features", key, width)


# --- label side ------------------------------------------------------------

def label_features(
    labels: DataFrame,
    mode: str = "optimized",
    sectors: dict[str, list[str]] = None,
    synonyms: DataFrame = None,
    key: str = "label_id",
) -> DataFrame:
    """``labels`` with ``key_terms``, ``synonyms``, ``insurance_sectors`` and
    ``sector_masks``."""
    out = with_key_terms(labels, "cleaned_label", mode)
    if mode == "optimized":
        out = lex.expand_synonyms(
            out.withColumn("_top", F.slice("key_terms", 1, 10)), key, "_top", synonyms
        ).drop("_top")
    else:
        out = lex.expand_synonyms_full(out, key, "key_terms", synonyms)
    out = lex.with_sectors(out, "cleaned_label", "insurance_sectors", mode, sectors)
    return lex.with_sector_masks(out, "cleaned_label", "sector_masks", mode, sectors)


def boosted(jaccard: Column) -> Column:
    return F.when(jaccard > 0.5, 0.5 + jaccard * 0.5).otherwise(jaccard)


def sector_scores(company_sets: DataFrame, labels: DataFrame) -> DataFrame:
    """``(term, label_id, value)`` for distinct company sector sets, whose ``term``
    is the key of their masks.

    Sets that share a sector are found by a join on its number; every distinct
    pair of sets is scored once, and labels are joined to it by their set.
    """
    masks = F.split("term", ",").cast("array<bigint>") if _is_wide(labels) else F.array(F.col("term").cast("bigint"))
    left = company_sets.select("term", masks.alias("a"))
    own = labels.select("label_id", lex.mask_key(F.col("sector_masks")).alias("_set"), F.col("sector_masks").alias("b"))
    right = own.where("_set <> ''").groupBy("_set").agg(F.first("b").alias("b"))
    pairs = unnest(left, ["term", "a"], lex.mask_bits(F.col("a")), "sector").join(
        unnest(right, ["_set", "b"], lex.mask_bits(F.col("b")), "sector"), "sector"
    ).select("term", "_set", "a", "b").distinct()
    scored = pairs.select("term", "_set", boosted(lex.jaccard(F.col("a"), F.col("b"))).alias("value"))
    return lookup_join(own.select("label_id", "_set"), scored, ["_set"], spread="label_id").select("term", "label_id", "value")


def _is_wide(labels: DataFrame) -> bool:
    """Whether sets of sectors take more than one integer, the same for all rows."""
    row = labels.select(F.size("sector_masks").alias("n")).first()
    return row is not None and row["n"] > 1


def label_table(
    labels: DataFrame,
    vocab: DataFrame = None,
    label_counts: DataFrame = None,
    company_sets: DataFrame = None,
    kinds: tuple[str, ...] = KINDS,
) -> DataFrame:
    """Label feature rows ``(kind, term, label_id, value)``, written once.

    ``value``: for grams idf times the label's unit weight, for words and
    synonyms the size of the label's set, for sectors the finished score.
    """
    def set_rows(members: Column) -> DataFrame:
        sets = labels.select("label_id", members.alias("ws"))
        size = F.size("ws").cast("double").alias("value")
        return unnest(sets, ["label_id", size], F.col("ws"), "term")

    parts = []
    if "gram" in kinds:
        # the label postings are the small side, the vocabulary the large one
        weighed = lookup_join(
            tfidf.kept_terms(vocab).select("term", "idf"), label_counts, ["term"], spread="idf"
        ).withColumn("weight", tfidf.sublinear(F.col("tf")) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("label_id")))
        parts.append(
            weighed.select(
                F.lit("gram").alias("kind"), "term", "label_id",
                (F.col("idf") * F.col("weight") / norm).alias("value"),
            )
        )
    if "word" in kinds:
        parts.append(
            set_rows(F.array_distinct(words(F.lower("label"))))
            .select(F.lit("word").alias("kind"), "term", "label_id", "value")
        )
    if "syn" in kinds:
        parts.append(
            set_rows(F.array_distinct("synonyms"))
            .select(F.lit("syn").alias("kind"), "term", "label_id", "value")
        )
    if "sectors" in kinds:
        parts.append(
            sector_scores(company_sets, labels)
            .select(F.lit("sectors").alias("kind"), "term", "label_id", "value")
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return materialize(rows, "labels")


# --- pairs -----------------------------------------------------------------

def distinct_sector_sets(features: DataFrame) -> DataFrame:
    return features.where(F.col("kind") == "sectors").select("term").distinct()


def company_norms(
    features: DataFrame, key: str, vocab: DataFrame, own_corpus: bool = True
) -> DataFrame:
    grams = features.where(F.col("kind") == "gram").select(key, "term", "w")
    weighed = tfidf.weigh(grams, vocab, own_corpus).select(
        key, (F.col("w") * F.col("idf")).alias("weight")
    )
    return tfidf.norms(weighed, key)


def pair_components(features: DataFrame, label_rows: DataFrame, key: str) -> DataFrame:
    """``(key, label_id, dot, wordnet, keyword, bonus)`` of the pairs that have
    a feature in common."""
    matched = lookup_join(
        features.where(F.col("kind") != SELF), label_rows, ["kind", "term"], spread=key
    )
    kind = F.col("kind")

    def of(name: str, column: str) -> Column:
        return F.when(kind == name, F.col(column))

    sums = matched.groupBy(key, "label_id").agg(
        F.coalesce(F.sum(F.when(kind == "gram", F.col("w") * F.col("value"))), F.lit(0.0)).alias("dot"),
        F.count(of("syn", "w")).alias("syn_common"),
        F.max(of("syn", "w")).alias("syn_company"),
        F.max(of("syn", "value")).alias("syn_label"),
        F.count(of("word", "w")).alias("word_common"),
        F.max(of("word", "value")).alias("word_label"),
        F.coalesce(F.max(of("sectors", "value")), F.lit(0.0)).alias("keyword"),
    )
    jaccard = F.col("syn_common") / (
        F.col("syn_company") + F.col("syn_label") - F.col("syn_common")
    )
    bonus = F.col("word_common") / F.col("word_label") * 0.3
    return sums.select(
        key, "label_id", "dot",
        F.coalesce(boosted(jaccard), F.lit(0.0)).alias("wordnet"),
        "keyword",
        F.coalesce(bonus, F.lit(0.0)).alias("bonus"),
    )


def best_pair_components(features: DataFrame, label_rows: DataFrame, key: str, best: int) -> DataFrame:
    """``pair_components`` without the pairs that share only sectors and cannot
    be among a company's ``best``.

    Companies of one sector set have the same sector scores.  Of the labels that
    share nothing else, only the best ones of the set can win, because the same
    number of labels scores at least as high.  Every other pair gets its sector
    score by a lookup on (set, label).
    """
    scores = label_rows.where(F.col("kind") == "sectors")
    order = Window.partitionBy("term").orderBy(F.desc("value"), F.desc("label_id"))
    winners = scores.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= best).drop("_rank")
    pairs = pair_components(
        features, label_rows.where(F.col("kind") != "sectors").unionByName(winners), key
    ).drop("keyword")
    own = features.where(F.col("kind") == "sectors").select(key, F.col("term").alias("_set"))
    score = scores.select(F.col("term").alias("_set"), "label_id", F.col("value").alias("_value"))
    found = lookup_join(pairs.join(own, key, "left"), score, ["_set", "label_id"], spread=key, how="left")
    return found.select(
        key, "label_id", "dot", "wordnet", F.coalesce("_value", F.lit(0.0)).alias("keyword"), "bonus"
    )


def with_tfidf(pairs: DataFrame, norms: DataFrame, key: str) -> DataFrame:
    """Cosine from the dot product (labels are unit vectors already)."""
    return pairs.join(norms, key, "left").withColumn(
        "tfidf", F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0))
    ).drop("dot", "norm")


def sector_fallback(
    companies: DataFrame,
    labels: DataFrame,
    key: str = "company_id",
    lexicon: dict[str, list[str]] = None,
) -> DataFrame:
    """``(key, label_id, label, score)``: the label closest to the company's
    sector, category and niche; companies without a label of 0.2 or more are
    absent.

    A word can only be inside a label if it is a part of one of the label's own
    words, so labels are indexed by their parts and joined by equality.
    """
    lexicon = lexicons.SECTOR_KEYWORDS if lexicon is None else lexicon
    info = F.lower(
        F.concat_ws(" ", *[
            F.coalesce(F.col(c), F.lit("")) for c in ("sector", "category", "niche")
            if c in companies.columns
        ])
    )
    # few distinct sector texts stand for all companies
    texts = companies.select(key, info.alias("info"))
    distinct = texts.select("info").distinct()
    info_words = (
        unnest(distinct, ["info"], words(F.col("info")), "part")
        .where(F.length("part") > 3)
        .groupBy("info", "part").agg(F.count(F.lit(1)).alias("times"))
    )
    named = labels.select("label_id", "label", F.lower("label").alias("low"))
    token = unnest(named, ["label_id"], F.array_distinct(words(F.col("low"))), "w")
    token = token.where(F.length("w") > 3)
    starts = unnest(token, ["label_id", "w"], F.sequence(F.lit(1), F.length("w") - 3), "i")
    from_start = F.transform(
        F.sequence(F.lit(4), F.length("w") - F.col("i") + 1),
        lambda n: F.substring(F.col("w"), F.col("i"), n),
    )
    parts = unnest(starts, ["label_id"], from_start, "part").distinct()
    # sizes are checked and joined from what is written, not computed twice
    parts = materialize(parts, "label_parts")
    by_word = lookup_join(info_words, parts, ["part"], spread="info").groupBy(
        "info", "label_id"
    ).agg((F.sum("times") * 0.2).alias("score"))

    left = lex.with_sectors(distinct, "info", "s", "basic", lexicon)
    right = lex.with_sectors(named, "low", "s", "basic", lexicon)
    label_sectors = materialize(unnest(right, ["label_id"], F.col("s"), "sector"), "label_sectors")
    by_sector = lookup_join(
        unnest(left, ["info"], F.col("s"), "sector"), label_sectors, ["sector"], spread="info",
    ).groupBy("info", "label_id").agg((F.count(F.lit(1)) * 0.3).alias("score"))

    # ties go to the first label; sums are compared to nine digits
    scored = by_word.unionByName(by_sector).groupBy("info", "label_id").agg(
        F.round(F.sum("score"), 9).alias("score")
    )
    best = scored.groupBy("info").agg(
        F.max(F.struct(F.col("score"), (-F.col("label_id")).alias("n"))).alias("b")
    ).select("info", F.col("b.score").alias("score"), (-F.col("b.n")).alias("label_id"))
    best = best.where(F.col("score") >= 0.2).join(named.select("label_id", "label"), "label_id")
    return lookup_join(texts, materialize(best, "sector_labels"), ["info"], spread=key).select(
        key, "label_id", "label", "score"
    )
