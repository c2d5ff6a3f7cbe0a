"""Company and label features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions import lexicons
from labelloom.functions.arrays import (
    SPACE, WORD, empty_strings, ngrams, unnest, vector_tokens, words,
)
from labelloom.functions.text import (
    clean_company_name, clean_text, whole_word,
)
from labelloom.plans.joins import lookup_join
from labelloom.plans.scratch import shuffle_width


def require_columns(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing column(s): {', '.join(missing)}")


def clean_names(df: DataFrame, column: str, whole: bool = False) -> DataFrame:
    require_columns(df, column)
    return df.withColumn(column, clean_company_name(F.col(column), whole))


# --- cleaned columns -------------------------------------------------------

def lemmatize(
    df: DataFrame, key: str, columns: list[str], lemmas: DataFrame
) -> DataFrame:
    """Replace every token of the (cleaned) columns by its lemma.

    Rows are spread by ``key`` first, so the tokens of one row meet again in
    the same partition and the regrouping needs no second shuffle.
    """
    spread = df.repartition(shuffle_width(df), key)
    cells = F.array(*[
        F.struct(F.lit(c).alias("name"), words(F.col(c)).alias("w")) for c in columns
    ])
    tokens = unnest(
        unnest(spread, [key], cells, "cell"),
        [key, F.col("cell.name").alias("name")], F.col("cell.w"), "surface", pos="pos",
    )
    table = lemmas.select("surface", "lemma").groupBy("surface").agg(F.min("lemma").alias("lemma"))
    found = lookup_join(
        tokens.withColumn("_spread", F.concat_ws(":", key, "pos")),
        table, ["surface"], spread="_spread", how="left",
    )
    token = F.struct("pos", F.coalesce("lemma", "surface").alias("w"))
    texts = found.groupBy(key).agg(*[
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("name") == c, token))),
                lambda t: t["w"],
            ),
            " ",
        ).alias(f"_lemma_{c}")
        for c in columns
    ])
    joined = spread.join(texts, key, "left")
    return joined.select(*[
        F.coalesce(f"_lemma_{c}", F.lit("")).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])


def clean_columns(
    df: DataFrame,
    columns: dict[str, str],
    key: str = None,
    lemmas: DataFrame = None,
    **options,
) -> DataFrame:
    """Add ``{source: target}`` cleaned columns.

    ``lemmas`` is a table ``(surface, lemma)`` or a ``lemmas.LemmaRules``.
    """
    from labelloom.operators.lemmas import LemmaRules, lemmatize_by_rules

    out = df.withColumns(
        {dst: clean_text(F.col(src), **options) for src, dst in columns.items()}
    )
    if lemmas is None or not columns:
        return out
    if key is None:
        raise ValueError("Lemmatizing needs the key column")
    replace = lemmatize_by_rules if isinstance(lemmas, LemmaRules) else lemmatize
    return replace(out, key, list(columns.values()), lemmas)


# --- weighted combined text ------------------------------------------------

def combined_text(repeats: dict[str, int]) -> Column:
    """Each non-blank column repeated, joined by spaces, in the given order."""
    parts = [
        F.when(
            F.rlike(F.col(c), F.lit(f"[^{SPACE[1:-1]}]")),
            F.array_join(F.array_repeat(F.col(c), n), " "),
        )
        for c, n in repeats.items()
    ]
    return F.concat_ws(" ", *parts)


def repeat_plan(df: DataFrame, repeats: dict[str, int] = None) -> dict[str, int]:
    """The combined-text columns that ``df`` has."""
    repeats = lexicons.COLUMN_REPEATS if repeats is None else repeats
    return {c: n for c, n in repeats.items() if c in df.columns}


def combined_term_counts(
    df: DataFrame, key: str, repeats: dict[str, int]
) -> DataFrame:
    """``(key, term, tf)`` of the combined text's 1- to 3-grams, without
    building the combined text.

    A column repeated ``n`` times is periodic: the window that starts at
    offset ``p`` of one copy occurs once per copy in which it still fits.
    Windows across two neighbouring columns are added one by one.  The work
    grows with the source text and not with the repeated text, which is 10 to
    25 times longer.
    """
    if any(n < 2 for n in repeats.values()):
        raise ValueError("Periodic counting needs at least two copies per column")
    spread = df.repartition(shuffle_width(df), key)
    tokens = spread.select(
        key, *[vector_tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(repeats)]
    )
    # e: one copy plus the two tokens that follow it, l: tokens per copy
    blocks = tokens.select(
        key,
        F.filter(
            F.array(*[
                F.struct(
                    F.slice(F.concat(f"t{i}", f"t{i}", f"t{i}"), F.lit(1), F.size(f"t{i}") + 2).alias("e"),
                    F.size(f"t{i}").alias("l"),
                    F.lit(n).alias("n"),
                )
                for i, n in enumerate(repeats.values())
            ]),
            lambda b: b["l"] > 0,
        ).alias("b"),
    )

    def windows(block: Column, g: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), block["l"] - 1),
            lambda p: F.struct(
                F.concat_ws(" ", *[F.get(block["e"], p + j) for j in range(g)]).alias("term"),
                (F.floor((block["n"] * block["l"] - g - p) / block["l"]) + 1).alias("n"),
            ),
        )

    def seam(left: Column, right: Column) -> Column:
        # the token before the last of a periodic block is the last of a copy
        # of length one
        last = F.get(left["e"], left["l"] - 1)
        before = F.get(left["e"], F.when(left["l"] > 1, left["l"] - 2).otherwise(0))
        first, second = F.get(right["e"], F.lit(0)), F.get(right["e"], F.lit(1))
        grams = [(last, first), (before, last, first), (last, first, second)]
        return F.array(*[
            F.struct(F.concat_ws(" ", *g).alias("term"), F.lit(1).cast("bigint").alias("n"))
            for g in grams
        ])

    inner = F.flatten(
        F.transform("b", lambda b: F.concat(windows(b, 1), windows(b, 2), windows(b, 3)))
    )
    seams = F.when(
        F.size("b") > 1,
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size("b") - 1),
                lambda j: seam(F.get("b", j - 1), F.get("b", j)),
            )
        ),
    ).otherwise(F.array().cast("array<struct<term:string,n:bigint>>"))
    return (
        unnest(blocks, [key], F.concat(inner, seams), "g")
        .where(F.col("g.n") > 0)
        .groupBy(key, F.col("g.term").alias("term"))
        .agg(F.sum("g.n").alias("tf"))
    )


# --- categories ------------------------------------------------------------

def industry_keywords(
    df: DataFrame, column: str, keywords: list[str] = None
) -> DataFrame:
    """``is_<keyword>`` flags and the ``detected_industries`` list.

    A keyword made of word characters is present exactly when it is one of the
    text's word runs, so the text is tokenized once for all of them.
    """
    require_columns(df, column)
    keywords = lexicons.INDUSTRY_KEYWORDS if keywords is None else keywords
    lowered = F.lower(F.coalesce(F.col(column), F.lit("")))
    simple = [k for k in keywords if k.replace("_", "a").isalnum()]
    hits = F.array_intersect(
        F.regexp_extract_all(lowered, F.lit(WORD + "+"), F.lit(0)),
        F.array(*map(F.lit, simple)) if simple else empty_strings(),
    )
    patterns = [
        F.when(F.rlike(lowered, F.lit(whole_word(k))), F.lit(k))
        for k in keywords if k not in simple
    ]
    if patterns:
        hits = F.concat(hits, F.filter(F.array(*patterns), lambda k: k.isNotNull()))
    found = df.withColumn("_hits", hits)
    flags = {f"is_{k}": F.array_contains("_hits", k).cast("int") for k in keywords}
    ordered = F.filter(
        F.array(*[F.when(F.array_contains("_hits", k), F.lit(k)) for k in keywords]),
        lambda k: k.isNotNull(),
    )
    return found.withColumns({**flags, "detected_industries": ordered}).drop("_hits")


def size_category(df: DataFrame, employees: str = "employees") -> DataFrame:
    """Unchanged when the column is missing."""
    if employees not in df.columns:
        return df
    n = F.col(employees)
    return df.withColumn(
        "size_category",
        F.when(n < 10, "Micro")
        .when(n.between(10, 49), "Small")
        .when(n.between(50, 249), "Medium")
        .when(n.between(250, 999), "Large")
        .when(n >= 1000, "Enterprise")
        .otherwise("Unknown"),
    )


# Fixed value: "city[, state][, country]".
_LOCATION = r"^([^,]+)(?:,\s*([^,]+))?(?:,\s*(.+))?"


def normalize_location(
    df: DataFrame, column: str, create_separate_columns: bool = True
) -> DataFrame:
    """City, state, country; with two parts the second one is the country."""
    if column not in df.columns or not create_separate_columns:
        return df
    city, state, country = (
        F.nullif(F.regexp_extract(column, _LOCATION, i), F.lit("")) for i in (1, 2, 3)
    )
    return df.withColumns({
        "city": city,
        "state": F.when(country.isNotNull(), state),
        "country": F.coalesce(country, state),
    })


# --- labels ----------------------------------------------------------------

def with_key_terms(
    df: DataFrame, column: str, mode: str = "optimized", name: str = "key_terms"
) -> DataFrame:
    """Words longer than three letters, then phrases: bigrams of two such words
    (optimized), or all bigrams and trigrams (basic)."""
    require_columns(df, column)
    if mode not in ("optimized", "basic"):
        raise ValueError(f"Unknown mode: {mode}")
    df = df.withColumn("_w", words(F.lower(F.col(column))))
    w = F.col("_w")
    longer = F.filter(w, lambda x: F.length(x) > 3)
    if mode == "basic":
        phrases = F.concat(ngrams(w, 2), ngrams(w, 3))
    else:
        phrases = F.filter(ngrams(w, 2), lambda g: F.rlike(g, F.lit("^[^ ]{4,} [^ ]{4,}$")))
    return df.withColumn(name, F.concat(longer, phrases)).drop("_w")


def label_phrases(label: Column) -> Column:
    """Contiguous phrases of at least two words, by start, then by end.

    ``label`` should be a plain array column of words.
    """
    size = F.size(label)
    return F.when(
        size > 1,
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), size - 2),
                lambda i: F.transform(
                    F.sequence(i + 2, size),
                    lambda j: F.array_join(F.slice(label, i + 1, j - i), " "),
                ),
            )
        ),
    ).otherwise(empty_strings())


def expand_labels(df: DataFrame, synonyms: dict[str, list[str]] = None) -> DataFrame:
    """``expanded_terms``: synonyms of every key inside the label, then the
    label's phrases; ``expanded_description`` and its cleaned form."""
    if "label" not in df.columns:
        return df
    synonyms = lexicons.LABEL_SYNONYMS if synonyms is None else synonyms
    lowered = F.lower("label")
    hits = [
        F.when(F.contains(lowered, F.lit(k.lower())), F.lit(" ".join(v)))
        for k, v in synonyms.items()
    ]
    out = df.withColumn("_w", words(F.col("label")))
    out = out.withColumn(
        "expanded_terms",
        F.array_join(
            F.concat(
                F.filter(F.array(*hits), lambda h: h.isNotNull()) if hits else empty_strings(),
                label_phrases(F.col("_w")),
            ),
            " ",
        ),
    ).drop("_w")
    parts = [F.col("label"), F.col("expanded_terms")]
    if "description" in df.columns:
        parts.insert(1, F.coalesce("description", F.lit("")))
    spaced = [p for part in parts for p in (F.lit(" "), part)][1:]
    return out.withColumn("expanded_description", F.concat(*spaced)).withColumn(
        "cleaned_expanded", clean_text(F.col("expanded_description"))
    )


def label_keywords(df: DataFrame, column: str = "cleaned_label") -> DataFrame:
    out = df.withColumn("_w", words(F.col(column)))
    return out.withColumns({
        "label_keywords": F.filter("_w", lambda w: F.length(w) > 3),
        "label_bigrams": ngrams(F.col("_w"), 2),
    }).drop("_w")
