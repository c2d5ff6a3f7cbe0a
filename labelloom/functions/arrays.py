"""Array expressions: tokens, n-grams, ordered list helpers, list cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Characters Python treats as white space, spelled for Java and RE2.
SPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body
    uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, keep: list, array: Column, name: str, pos: str = None) -> DataFrame:
    """One row per element of ``array``, next to the ``keep`` columns.

    A plain explode makes Spark add a filter on the array's size and push it
    below every projection, so the array would be computed twice.  The outer
    form with a filter on its output does not.
    """
    if pos is None:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return rows.where(F.col(name).isNotNull())


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def words(text: Column) -> Column:
    """Tokens between white space; no empty tokens; null gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.filter(parts, lambda w: w != "")


def vector_tokens(text: Column) -> Column:
    """Lower-case runs of at least two word characters."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(lowered, F.lit(WORD + "{2,}"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined windows of ``n`` tokens.

    ``tokens`` should be a plain column: the window reads it per position.
    """
    if n == 1:
        return tokens
    size = F.size(tokens)
    window = F.transform(
        F.sequence(F.lit(0), size - n),
        lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)]),
    )
    return F.when(size >= n, window).otherwise(empty_strings())


def ngram_range(tokens: Column, low: int, high: int) -> Column:
    return F.concat(*[ngrams(tokens, n) for n in range(low, high + 1)])


def counted(items: Column) -> Column:
    """``(term, tf)`` of every distinct element, by one sort; null if there is none."""
    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), size - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(ordered, i).alias("term"),
            (F.coalesce(F.get(at, j + 1), size) - i).cast("bigint").alias("tf"),
        )))

    return let(F.sort_array(items), lambda ordered: F.when(F.size(ordered) > 0, runs(ordered)))


def python_list(cell: Column, element: str) -> Column:
    """List cell written as a Python repr; anything unreadable is empty."""
    kind = f"array<{element}>"
    parsed = F.from_json(
        cell, kind, {"allowBackslashEscapingAnyCharacter": "true"}
    )
    return F.coalesce(parsed, F.array().cast(kind))


def label_list(cell: Column) -> Column:
    """Label cell: Python list, comma list, or ``Unclassified`` / null."""
    items = F.filter(
        F.transform(F.split(cell, ","), lambda x: F.trim(x)), lambda x: x != ""
    )
    is_list = F.startswith(cell, F.lit("[")) & F.endswith(cell, F.lit("]"))
    return (
        F.when(cell.isNull() | (cell == "Unclassified"), empty_strings())
        .when(is_list, python_list(cell, "string"))
        .otherwise(items)
    )


def score_list(cell: Column) -> Column:
    return python_list(cell, "double")
