"""Top-k similarity join that forms no hopeless pair.

A company's dot product with any label is at most the sum of its terms' bounds,
``w * best``, where ``best`` is the greatest value the term has in any label.

* A company's k-th best dot product is at least ``w * floor`` of any of its
  terms, ``floor`` being the k-th greatest value of the term; only pairs that
  reach this or the threshold can be ranked (its *bar*).
* Terms whose bounds together stay below the bar cannot carry a pair alone.
  They are chosen by bound per label, so that common words of little weight come
  first, and form no pairs; the other terms are *essential*.
* A pair met in an essential term is not formed when its product there, with the
  bounds of all other terms, stays below the bar.
* The k-th best of a company's partial sums raises the bar once more.  Only pairs
  that still reach it are completed by their non-essential terms.

All bounds are exact, so the ranked pairs are those of the full join.  A company's
terms are one row of arrays (never more than its text holds); all steps keep the
companies' partitioning, and the label side is joined by ``lookup_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.plans.joins import lookup_join
from labelloom.plans.scratch import materialize, materialize_bucketed, shuffle_width

#: Ranks and thresholds are taken on scores rounded to nine digits.
SLACK = 1e-8


def term_bounds(postings: DataFrame, top_k: int) -> DataFrame:
    """``(term, best, floor, n)`` of label postings ``(term, label_id, value)``:
    greatest value, ``top_k``-th greatest value (0 for fewer labels) and labels of
    every term.  One shuffle by term gives all three."""
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("value")))
    ranked = postings.select("term", "value", place.alias("place"))
    return ranked.groupBy("term").agg(
        F.max("value").alias("best"),
        F.coalesce(F.max(F.when(F.col("place") == top_k, F.col("value"))), F.lit(0.0)).alias("floor"),
        F.count(F.lit(1)).alias("n"),
    )


def bounded_terms(grams: DataFrame, norms: DataFrame, bounds: DataFrame, key: str, threshold: float) -> DataFrame:
    """One row per company that shares a term with a label: ``norm``, ``bar``,
    ``total`` (of all bounds), ``rest`` (of the non-essential ones), and its terms
    as arrays ``essential`` and ``others`` of (cheap, term, w, bound)."""
    bound = F.col("w") * F.col("best")
    known = lookup_join(grams.select(key, "term", "w"), bounds, ["term"], spread=key)
    term = F.struct((bound / F.col("n")).alias("cheap"), "term", "w", bound.alias("bound"))
    sums = known.groupBy(key).agg(
        F.max(F.col("w") * F.col("floor")).alias("reach"), F.sum(bound).alias("total"),
        F.sort_array(F.collect_list(term)).alias("terms"),
    )
    bar = F.greatest(F.col("reach"), F.lit(float(threshold)) * F.col("norm")) - F.lit(SLACK) * F.col("norm")

    def take(state: Column, t: Column) -> Column:
        # bounds are positive: after one term that does not fit, no other does
        fits = state["rest"] + t["bound"] < state["bar"]
        return F.struct(
            state["bar"].alias("bar"),
            F.when(fits, state["rest"] + t["bound"]).otherwise(state["rest"]).alias("rest"),
            (state["n"] + F.when(fits & (state["n"] == state["seen"]), 1).otherwise(0)).alias("n"),
            (state["seen"] + 1).alias("seen"),
        )

    start = F.struct(F.col("bar").alias("bar"), F.lit(0.0).alias("rest"), F.lit(0).alias("n"), F.lit(0).alias("seen"))
    cut = F.aggregate("terms", start, take)
    rows = sums.join(norms, key).withColumn("bar", bar).withColumn("cut", cut)
    return rows.select(
        key, "norm", "bar", "total", "cut.rest",
        F.slice("terms", F.col("cut.n") + 1, F.size("terms")).alias("essential"),
        F.slice("terms", F.lit(1), F.col("cut.n")).alias("others"),
    )


def partial_sums(companies: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """Every formed pair with the sum over its essential terms."""
    terms = companies.select(key, "norm", "bar", "total", "rest", F.inline("essential"))
    met = lookup_join(terms, postings, ["term"], spread=key).withColumn("product", F.col("w") * F.col("value"))
    return (
        met.where(F.col("product") + F.col("total") - F.col("bound") >= F.col("bar"))
        .groupBy(key, "label_id")
        .agg(F.sum("product").alias("partial"), *[F.first(c).alias(c) for c in ("norm", "bar", "rest")])
    )


def survivors(pairs: DataFrame, key: str, top_k: int) -> DataFrame:
    """Pairs that may still be among their company's best ones."""
    best = Window.partitionBy(key).orderBy(F.desc("partial"), "label_id")
    kth = F.nth_value("partial", top_k).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bar = F.greatest("bar", F.col("kth") - SLACK * F.col("norm"))  # skips a null
    return pairs.withColumn("kth", kth).where(F.col("partial") + F.col("rest") >= bar).drop("kth", "bar", "rest")


def _completed(pairs: DataFrame, companies: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """``dot`` of every pair: its partial sum and the non-essential terms both have."""
    others = pairs.join(companies.select(key, "others"), key)
    looked_up = others.select(key, "label_id", "norm", "partial", F.explode_outer("others").alias("t")).select(
        key, "label_id", "norm", "partial", F.col("t.term").alias("term"), F.col("t.w").alias("w")
    )
    found = lookup_join(looked_up, postings, ["term", "label_id"], spread=key, how="left")
    added = F.coalesce(F.sum(F.col("w") * F.col("value")), F.lit(0.0))
    return found.groupBy(key, "label_id").agg(
        F.first("norm").alias("norm"), (F.first("partial") + added).alias("dot")
    )


def best_pairs(
    grams: DataFrame, norms: DataFrame, postings: DataFrame, key: str, top_k: int, threshold: float
) -> DataFrame:
    """``(key, label_id, norm, dot)`` of pairs that hold every company's ``top_k``
    best ones at or above ``threshold`` (a cosine).

    ``grams`` are company postings ``(key, term, w)`` bucketed by ``key``,
    ``postings`` label postings ``(term, label_id, value)``.
    """
    bounds = materialize(term_bounds(postings, top_k), "term_bounds")
    width = shuffle_width(grams)
    companies = materialize_bucketed(
        bounded_terms(grams, norms, bounds, key, threshold), "bounded_terms", key, width
    )
    pairs = survivors(partial_sums(companies, postings, key), key, top_k)
    return _completed(pairs, companies, postings, key)
