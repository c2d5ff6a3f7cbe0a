"""Weighted score, rescaling, top-k, fallbacks, label lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

UNCLASSIFIED = "Unclassified"
# Label and score of a company that nothing else fits.
GENERIC_LABEL = "General Insurance"
GENERIC_SCORE = 0.1
#: Weighted scores before they are rescaled, in the order of the labels.
RAW_SCORES = "insurance_label_raw_scores"
# ranks must not depend on the order in which doubles were added
DIGITS = 9


@dataclass(frozen=True)
class Weights:
    """Relative weights; they are normalized when used."""

    tfidf: float = 0.6
    wordnet: float = 0.25
    keyword: float = 0.15

    def normalized(self) -> "Weights":
        total = self.tfidf + self.wordnet + self.keyword
        if total <= 0:
            return self
        return Weights(self.tfidf / total, self.wordnet / total, self.keyword / total)


def normalized_weights(df: DataFrame, tfidf: str, wordnet: str, keyword: str) -> DataFrame:
    """Weight columns divided by their sum, unless the sum is not positive."""
    total = F.col(tfidf) + F.col(wordnet) + F.col(keyword)
    return df.withColumns({
        f"{name}_weight": F.when(total > 0, F.col(c) / total).otherwise(F.col(c))
        for name, c in (("tfidf", tfidf), ("wordnet", wordnet), ("keyword", keyword))
    })


def weighted_score(tfidf: Column, wordnet: Column, keyword: Column) -> Column:
    return (
        tfidf * F.col("tfidf") + keyword * F.col("keyword") + wordnet * F.col("wordnet")
        + F.col("bonus")
    )


def ensemble_score(pairs: DataFrame, weights: Weights) -> DataFrame:
    w = weights.normalized()
    return pairs.withColumn(
        "raw_score", weighted_score(F.lit(w.tfidf), F.lit(w.wordnet), F.lit(w.keyword))
    )


def check_top_k(top_k: int) -> None:
    if top_k < 1:
        raise ValueError("top_k must be at least 1")


def best_first(key: list[str], score: str):
    return Window.partitionBy(*key).orderBy(
        F.round(score, DIGITS).desc(), F.col("label_id").desc()
    )


def top_k_pairs(pairs: DataFrame, key: list[str], score: str, top_k: int) -> DataFrame:
    """The ``top_k`` best positive pairs per key, with their ``rank``.

    The filter directly on the row number lets Spark drop rows before the
    window, in every task.
    """
    check_top_k(top_k)
    ranked = pairs.where(F.col(score) > 0).withColumn(
        "rank", F.row_number().over(best_first(key, score))
    )
    return ranked.where(F.col("rank") <= top_k)


def rescale(pairs: DataFrame, key: list[str], raw: str = "raw_score") -> DataFrame:
    """``score``: the square of the raw score over the square of the company's
    maximum.  Works on all pairs or on each company's best pairs."""
    squared = F.col(raw) * F.col(raw)
    top = F.max(squared).over(Window.partitionBy(*key))
    return pairs.withColumn("score", F.when(top > 0, squared / top).otherwise(squared))


def at_least(score: str, threshold) -> Column:
    return F.round(score, DIGITS) >= threshold


def pad_with_zero_scores(
    ranked: DataFrame, ids: DataFrame, labels: DataFrame, key: str, top_k: int
) -> DataFrame:
    """Fill up to ``top_k`` rows per company with labels that share nothing
    with it, last label first.  Needed only for thresholds of zero or less.

    A company lacks at most ``top_k`` rows and excludes at most ``top_k``
    labels, so the last ``2 * top_k`` labels suffice.
    """
    last = [
        (r["label_id"])
        for r in labels.orderBy(F.desc("label_id")).limit(2 * top_k).select("label_id").collect()
    ]
    have = ids.join(
        ranked.groupBy(key).agg(F.collect_list("label_id").alias("have")), key, "left"
    )
    taken = F.coalesce("have", F.array().cast("array<bigint>"))
    free = F.array_except(F.array(*[F.lit(i).cast("bigint") for i in last]), taken)
    room = F.greatest(F.lit(0), F.lit(top_k) - F.size(taken))
    fill = have.select(
        key, F.size(taken).alias("n"), F.posexplode(F.slice(free, F.lit(1), room)).alias("p", "label_id")
    ).select(key, "label_id", (F.col("n") + F.col("p") + 1).alias("rank"))
    return ranked.unionByName(
        fill.withColumn("score", F.lit(0.0)), allowMissingColumns=True
    )


def label_lists(matches: DataFrame, key: list[str]) -> DataFrame:
    """Labels and scores in rank order; raw scores too where ``matches`` has them."""
    raw = [F.coalesce("raw_score", F.lit(0.0)).alias("raw_score")] if "raw_score" in matches.columns else []
    lists = matches.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "label", "score", *raw))).alias("m")
    )
    names = {"label": "insurance_labels", "score": "insurance_label_scores"}
    if raw:
        names["raw_score"] = RAW_SCORES
    return lists.select(*key, *[F.col("m")[field].alias(name) for field, name in names.items()])


def with_label_text(df: DataFrame) -> DataFrame:
    """Missing lists become empty; the text form joins the labels."""
    labels = F.coalesce("insurance_labels", F.array().cast("array<string>"))
    scores = [c for c in ("insurance_label_scores", RAW_SCORES) if c in df.columns]
    return df.withColumns({
        "insurance_labels": labels,
        **{c: F.coalesce(c, F.array().cast("array<double>")) for c in scores},
        "insurance_label": F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise(UNCLASSIFIED),
    })


def generic_label(labels: DataFrame) -> Column:
    """First label that speaks of general insurance, else the fixed text."""
    low = F.lower("label")
    row = (
        labels.where(F.contains(low, F.lit("general")) & F.contains(low, F.lit("insurance")))
        .orderBy("label_id").select("label").first()
    )
    return F.lit(row["label"] if row else GENERIC_LABEL)


def last_label(labels: DataFrame) -> str | None:
    row = labels.orderBy(F.desc("label_id")).select("label").first()
    return row["label"] if row else None


def fallback_chain(
    classified: DataFrame,
    labels: DataFrame,
    companies: DataFrame,
    key: str = "company_id",
    require_positive_best: bool = False,
    sector_lexicon: dict[str, list[str]] = None,
) -> DataFrame:
    """Give every company without any positive pair one label.

    A non-empty taxonomy always has a best label: when all scores are zero it
    is the last one, with score 0.  ``require_positive_best`` (or an empty
    taxonomy) goes on instead to the sector label and then to the generic label.
    """
    from labelloom.operators.similarity import sector_fallback

    out = classified
    last = last_label(labels)
    if last is not None and not require_positive_best:
        label, score = F.lit(last), F.lit(0.0)
    else:
        sector = sector_fallback(companies, labels, key, sector_lexicon).select(
            key, F.col("label").alias("_sector"), F.col("score").alias("_sector_score")
        )
        out = out.join(sector, key, "left")
        label = F.coalesce(F.col("_sector"), generic_label(labels))
        score = F.coalesce(F.col("_sector_score"), F.lit(GENERIC_SCORE))
    empty = F.coalesce(F.size("insurance_labels"), F.lit(0)) == 0
    filled = {"insurance_labels": label, "insurance_label_scores": score}
    if RAW_SCORES in out.columns:
        filled[RAW_SCORES] = F.lit(0.0)  # nothing was similar
    return out.withColumns({
        c: F.when(empty, F.array(value)).otherwise(F.col(c)) for c, value in filled.items()
    }).drop("_sector", "_sector_score")
