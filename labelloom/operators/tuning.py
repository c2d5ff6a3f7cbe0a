"""Parameter search: all trials in one job.

Similarity components do not depend on the parameters.  They are computed once
for the sample; each trial only weighs, ranks and cuts them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions.arrays import unnest
from labelloom.operators import ranking
from labelloom.plans.joins import lookup_join
from labelloom.plans.scratch import materialize, positions

TRIAL_SCHEMA = (
    "trial_id bigint, top_k int, threshold double, "
    "tfidf_weight double, wordnet_weight double, keyword_weight double"
)
SAMPLE = 200
#: Trials that meet a pair in one join key.
TRIAL_BLOCK = 1_000


def sample(df: DataFrame, key: str = "company_id", n: int | None = SAMPLE, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` companies, the same for any partitioning;
    ``n=None`` takes all."""
    if n is None:
        return df
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(order, key).limit(n)


def search_space(spark, n_trials: int = 30, seed: int = 42) -> DataFrame:
    """Random trials: top_k 1 to 10, threshold 0.01 to 0.3, three relative
    weights 0.1 to 1.0."""
    def uniform(offset: int, low: float, high: float):
        # a digest per trial and parameter does not depend on partitioning
        unit = F.pmod(F.xxhash64(F.lit(seed), F.lit(offset), "id"), F.lit(1_000_003)) / 1_000_003
        return F.lit(low) + unit * (high - low)

    relative = spark.range(n_trials).select(
        F.col("id").alias("trial_id"),
        F.floor(uniform(0, 1.0, 11.0)).cast("int").alias("top_k"),
        uniform(1, 0.01, 0.3).alias("threshold"),
        uniform(2, 0.1, 1.0).alias("t"),
        uniform(3, 0.1, 1.0).alias("w"),
        uniform(4, 0.1, 1.0).alias("k"),
    )
    return ranking.normalized_weights(relative, "t", "w", "k").drop("t", "w", "k")


def with_trials(rows: DataFrame, trials: DataFrame, spread: str) -> DataFrame:
    """Every row under every trial.

    That product is what a search evaluates.  Trials are dealt to blocks and
    joined by block: broadcast if their checked size allows it, else by a
    salted shuffle, so any number of them will do.
    """
    blocks = -(-trials.count() // TRIAL_BLOCK)
    if not blocks:
        return rows.join(trials.withColumn("_block", F.lit(0)), F.lit(False)).drop("_block")
    dealt = trials.withColumn("_block", F.pmod(F.xxhash64("trial_id"), F.lit(blocks)))
    each = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return lookup_join(each, dealt, ["_block"], spread=spread).drop("_block")


def trial_matches(
    ids: DataFrame, pairs: DataFrame, labels: DataFrame, trials: DataFrame, key: str
) -> DataFrame:
    """``(trial_id, key, insurance_labels, insurance_label_scores)``; every
    company has at least one label in every trial."""
    trials = trials.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in TRIAL_SCHEMA.split(", ")])
    per_trial = with_trials(pairs, trials, key).withColumn(
        "raw_score",
        ranking.weighted_score(F.col("tfidf_weight"), F.col("wordnet_weight"), F.col("keyword_weight")),
    )
    keys = ["trial_id", key]
    highest = trials.agg(F.max("top_k")).first()[0]
    ranked = ranking.top_k_pairs(per_trial, keys, "raw_score", highest)
    ranked = ranking.rescale(ranked.where(F.col("rank") <= F.col("top_k")), keys)
    # the best pair stays whatever the threshold is
    matches = ranked.where(
        ranking.at_least("score", F.col("threshold")) | (F.col("rank") == 1)
    )
    named = lookup_join(matches, labels.select("label_id", "label"), ["label_id"], spread=key)
    lists = ranking.label_lists(named, keys)
    last = ranking.last_label(labels)
    out = with_trials(ids.select(key), trials.select("trial_id"), key).select("trial_id", key).join(lists, keys, "left")
    return out.withColumns({
        "insurance_labels": F.coalesce("insurance_labels", F.array(F.lit(last))),
        "insurance_label_scores": F.coalesce("insurance_label_scores", F.array(F.lit(0.0))),
    })


def objective(
    classified: DataFrame,
    n_labels: int,
    coverage_weight: float = 0.4,
    confidence_weight: float = 0.4,
    diversity_weight: float = 0.2,
) -> DataFrame:
    """``(trial_id, coverage, confidence, diversity, score)`` per trial."""
    labels = F.coalesce("insurance_labels", F.array().cast("array<string>"))
    scores = F.col("insurance_label_scores")
    mean = F.when(
        F.size(scores) > 0,
        F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores),
    )
    per_trial = classified.groupBy("trial_id").agg(
        F.avg(F.when(F.size(labels) > 0, 1.0).otherwise(0.0)).alias("coverage"),
        F.coalesce(F.avg(mean), F.lit(0.0)).alias("confidence"),
    )
    used = (
        unnest(classified, ["trial_id"], labels, "label").distinct()
        .groupBy("trial_id").agg(F.count(F.lit(1)).alias("used"))
    )
    diversity = F.coalesce(F.col("used"), F.lit(0)) / n_labels if n_labels else F.lit(0.0)
    return per_trial.join(used, "trial_id", "left").select(
        "trial_id", "coverage", "confidence", diversity.cast("double").alias("diversity"),
    ).withColumn(
        "score",
        coverage_weight * F.col("coverage") + confidence_weight * F.col("confidence")
        + diversity_weight * F.col("diversity"),
    )


def annotated_objective(
    classified: DataFrame, given: DataFrame, key: str = "company_id", labels: str = "insurance_labels"
) -> DataFrame:
    """Agreement with given labels per trial: precision, recall and F1 over all
    assignments (micro) and as the mean over labels (macro).

    ``classified`` has trial_id, key and a list of labels, ``given`` a row
    ``(key, label)`` per given label.  Companies without any given label are not
    annotated and do not count.  A label counts for macro if it is given or
    predicted in the trial; a share without a denominator is 0.
    """
    truth = given.select(key, "label").where(F.col("label").isNotNull()).distinct()
    annotated = truth.select(key).distinct()
    guessed = unnest(classified, ["trial_id", key], F.array_distinct(F.col(labels)), "label").join(annotated, key, "left_semi")
    each_trial = classified.select("trial_id", key).distinct()
    wanted = each_trial.join(truth, key).select("trial_id", key, "label")
    rows = guessed.select("trial_id", key, "label", F.lit(1).alias("p"), F.lit(0).alias("g")).unionAll(
        wanted.select("trial_id", key, "label", F.lit(0).alias("p"), F.lit(1).alias("g"))
    )
    cells = rows.groupBy("trial_id", key, "label").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    counts = cells.groupBy("trial_id", "label").agg(
        F.sum("p").alias("p"), F.sum("g").alias("g"), F.sum(F.col("p") * F.col("g")).alias("both")
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    def three(p: Column, g: Column, both: Column) -> tuple[Column, ...]:
        return share(both, p), share(both, g), share(2 * both, p + g)

    total = [F.sum(c) for c in ("p", "g", "both")]
    names = ("precision", "recall", "f1")
    micro = [c.alias(f"micro_{n}") for n, c in zip(names, three(*total))]
    macro = [F.avg(c).alias(f"macro_{n}") for n, c in zip(names, three(*map(F.col, ("p", "g", "both"))))]
    found = counts.groupBy("trial_id").agg(*micro, *macro)
    filled = [F.coalesce(f"{kind}_{n}", F.lit(0.0)).alias(f"{kind}_{n}") for kind in ("micro", "macro") for n in names]
    return classified.select("trial_id").distinct().join(found, "trial_id", "left").select("trial_id", *filled)


def history(trials: DataFrame, results: DataFrame) -> DataFrame:
    """Trials with their scores, best first."""
    joined = trials.join(results, "trial_id")
    placed = positions(joined, [F.round("score", 9).desc(), "trial_id"], "position")
    return placed.withColumn("position", (F.col("position") + 1).cast("int")).orderBy("position")


@dataclass(frozen=True)
class Bounds:
    """What the trials to come cannot exceed: their greatest top_k and, weight by
    weight, their least normalized weights."""

    top_k: int | None
    weights: ranking.Weights | None

    @staticmethod
    def of(trials: DataFrame) -> "Bounds":
        lowest = trials.agg(*[F.min(f"{w}_weight") for w in ("tfidf", "wordnet", "keyword")]).first()
        weights = None if None in lowest else ranking.Weights(*lowest)
        return Bounds(trials.agg(F.max("top_k")).first()[0], weights)


@dataclass(frozen=True)
class Prepared:
    """All that trials share: companies, their scored pairs, and labels."""

    ids: DataFrame
    pairs: DataFrame
    labels: DataFrame
    key: str


def prepare(
    companies: DataFrame,
    labels: DataFrame,
    bounds: Bounds,
    key: str = "company_id",
    n: int | None = SAMPLE,
    seed: int = 42,
    **options,
) -> Prepared:
    """Similarity components of a sample, written once.  Pairs that no trial within
    the bounds can rank among its best are not built."""
    from labelloom.plans import classify

    labels = materialize(labels, "taxonomy")
    chosen = materialize(sample(companies, key, n, seed), "sample")
    best = bounds.top_k if bounds.weights is not None and classify.prunable(bounds.weights) else None
    rows, pairs = classify.ensemble_pairs(chosen, labels, key=key, best=best, **options)
    return Prepared(classify.company_ids(rows, key), materialize(pairs, "components"), labels, key)


def evaluate(parts: Prepared, trials: DataFrame) -> DataFrame:
    """History of the trials, best first."""
    matches = trial_matches(parts.ids, parts.pairs, parts.labels, trials, parts.key)
    return history(trials, objective(matches, parts.labels.count()))


def search(
    companies: DataFrame,
    labels: DataFrame,
    trials: DataFrame,
    key: str = "company_id",
    n: int | None = SAMPLE,
    seed: int = 42,
    **options,
) -> DataFrame:
    """History of all trials on a sample of the companies (``n=None``: all)."""
    return evaluate(prepare(companies, labels, Bounds.of(trials), key, n, seed, **options), trials)
