"""Model-guided search over a study that is stored and resumed.

Past trials are split into the best share and the rest.  For every parameter the
two groups have a density each: normal kernels at the trials' values and a uniform
prior over the range.  A proposal draws candidates per parameter from the good
trials' kernels and takes the one whose good density is greatest against the bad
one.  Proposals come in blocks; a block is drawn from the history so far, scored in
one job by ``tuning`` and appended to the study.

Draws are digests of seed, trial and candidate, so a search gives the same trials
for any partitioning, and a resumed search those of an uninterrupted one.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelloom.operators import ranking, tuning
from labelloom.plans.joins import lookup_join
from labelloom.plans.scratch import materialize, positions
from labelloom.sources.readers import exists

#: Parameter -> least and greatest value, and whether it is a whole number.
SPACE = {
    "top_k": (1.0, 10.0, True),
    "threshold": (0.01, 0.3, False),
    "tfidf_weight": (0.04, 0.9, False),
    "wordnet_weight": (0.04, 0.9, False),
    "keyword_weight": (0.04, 0.9, False),
}
GOOD_SHARE = 0.25
CANDIDATES = 24
_PRIME = 1_000_003


def ranges(spark: SparkSession, space: dict = None) -> DataFrame:
    rows = [(i, p, lo, hi, whole) for i, (p, (lo, hi, whole)) in enumerate((space or SPACE).items())]
    return spark.createDataFrame(rows, "number int, parameter string, low double, high double, whole boolean")


def observations(history: DataFrame, good_share: float = GOOD_SHARE, space: dict = None) -> DataFrame:
    """``(parameter, value, good, place)`` of every trial: the best share of the
    trials (at least one) is good, ``place`` is the rank."""
    names = list(space or SPACE)
    ranked = positions(history.select("trial_id", "score", *names), [F.round("score", 9).desc(), "trial_id"], "place")
    good = F.ceil(F.lit(good_share) * F.lit(history.count()))
    cells = F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).cast("double").alias("value")) for n in names])
    return ranked.select("place", (F.col("place") < good).alias("good"), F.inline(cells))


def widths(seen: DataFrame, spans: DataFrame) -> DataFrame:
    """``(parameter, good, n, width)``: kernels get narrower with more trials, and
    never narrower than a fiftieth of the range."""
    shape = seen.groupBy("parameter", "good").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("spread"))
    span = F.col("high") - F.col("low")
    width = F.greatest(F.col("spread") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), span / 50)
    return shape.join(F.broadcast(spans), "parameter").select("parameter", "good", "n", width.alias("width"))


def _kernel(x: Column, center: Column, width: Column) -> Column:
    return F.exp(-F.pow((x - center) / width, F.lit(2.0)) / 2) / (width * math.sqrt(2 * math.pi))


def densities(points: DataFrame, seen: DataFrame, spans: DataFrame, ids: list[str]) -> DataFrame:
    """``points`` (ids, parameter, x) with the densities ``good`` and ``bad``.

    Every point meets every trial of its parameter, which is what a density is;
    the sums are combined before the shuffle.
    """
    shape = materialize(seen.join(widths(seen, spans), ["parameter", "good"]), "kernels")
    met = lookup_join(points.select(*ids, "parameter", "x"), shape.withColumnRenamed("good", "is_good"), ["parameter"], spread=ids[-1])
    met = met.withColumn("k", _kernel(F.col("x"), F.col("value"), F.col("width")))

    def group(kind: Column) -> list[Column]:
        return [F.coalesce(F.sum(F.when(kind, F.col("k"))), F.lit(0.0)), F.count(F.when(kind, 1))]

    good, bad = group(F.col("is_good")), group(~F.col("is_good"))
    sums = met.groupBy(*ids, "parameter", "x").agg(*[c.alias(n) for c, n in zip(good + bad, ("gs", "gn", "bs", "bn"))])
    prior = 1 / (F.col("high") - F.col("low"))
    return sums.join(F.broadcast(spans), "parameter").select(
        *ids, "parameter", "x",
        ((prior + F.col("gs")) / (F.col("gn") + 1)).alias("good"), ((prior + F.col("bs")) / (F.col("bn") + 1)).alias("bad"),
    )


def _uniform(seed: int, use: int) -> Column:
    """A number in (0, 1) by trial, parameter and candidate."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(use), "trial_id", "number", "candidate"), F.lit(_PRIME)) + 0.5) / _PRIME


def propose(history: DataFrame, trials: DataFrame, seed: int = 42, good_share: float = GOOD_SHARE, space: dict = None) -> DataFrame:
    """A trial for every ``trial_id`` of ``trials``, in the columns of a search space."""
    spark = history.sparkSession
    spans = ranges(spark, space)
    seen = materialize(observations(history, good_share, space), "observations")
    shape = widths(seen, spans).where("good").select("parameter", "n", "width")
    drawn = (
        trials.select("trial_id", F.explode(F.sequence(F.lit(0), F.lit(CANDIDATES - 1))).alias("candidate"))
        .select("*", F.inline(F.array(*[
            F.struct(F.lit(i).alias("number"), F.lit(p).alias("parameter"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(w).alias("whole"))
            for i, (p, (lo, hi, w)) in enumerate((space or SPACE).items())
        ])))
        .join(F.broadcast(shape), "parameter")
        # place n stands for the prior
        .withColumn("place", F.floor(_uniform(seed, 1) * (F.col("n") + 1)))
    )
    centers = seen.where("good").select("parameter", "place", "value")
    drawn = lookup_join(drawn, centers, ["parameter", "place"], spread="trial_id", how="left")
    normal = F.sqrt(-2 * F.log(_uniform(seed, 2))) * F.cos(2 * math.pi * _uniform(seed, 3))
    anywhere = F.col("low") + _uniform(seed, 4) * (F.col("high") - F.col("low"))
    x = F.least("high", F.greatest("low", F.coalesce(F.col("value") + F.col("width") * normal, anywhere)))
    points = drawn.withColumn("x", F.when(F.col("whole"), F.round(x)).otherwise(x))
    scored = densities(points, seen, spans, ["trial_id", "candidate"])
    order = F.struct(F.round(F.col("good") / F.col("bad"), 9), F.col("candidate"))
    best = scored.groupBy("trial_id").pivot("parameter", list(space or SPACE)).agg(F.max_by("x", order))
    best = best.withColumn("top_k", F.col("top_k").cast("int"))
    for w in ("tfidf", "wordnet", "keyword"):
        best = best.withColumnRenamed(f"{w}_weight", f"_{w}")
    return ranking.normalized_weights(best, "_tfidf", "_wordnet", "_keyword").select(*[c.split()[0] for c in tuning.TRIAL_SCHEMA.split(", ")])


def load_study(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def search(
    companies: DataFrame,
    labels: DataFrame,
    path: str,
    n_trials: int = 30,
    block: int = 10,
    startup: int = 10,
    seconds: float = None,
    key: str = "company_id",
    n: int | None = tuning.SAMPLE,
    seed: int = 42,
    good_share: float = GOOD_SHARE,
    **options,
) -> DataFrame:
    """History, best first, of the study at ``path`` after up to ``n_trials`` more.

    The first ``startup`` trials of a study are random.  No block starts after
    ``seconds``; every block is stored before the next one, so a search that was
    ended goes on from there.  A history of ``tuning.search`` can be a study.
    """
    spark, deadline = companies.sparkSession, seconds and time.monotonic() + seconds
    parts = tuning.prepare(companies, labels, tuning.Bounds(10, ranking.Weights(0.04, 0.04, 0.04)), key, n, seed, **options)
    study = load_study(spark, path)
    count, last = study.agg(F.count(F.lit(1)), F.max("trial_id")).first() if study is not None else (0, None)
    first = -1 if last is None else last
    wanted = count + n_trials
    while count < wanted and not (deadline and time.monotonic() > deadline):
        size = min(block, wanted - count, startup - count if count < startup else block)
        ids = spark.range(first + 1, first + 1 + size).withColumnRenamed("id", "trial_id")
        if count < startup:
            # by trial number, so that blocks of any size draw the same trials
            trials = tuning.search_space(spark, first + 1 + size, seed).where(F.col("trial_id") > first)
        else:
            trials = propose(study, ids, seed, good_share)
        trials = materialize(trials, "trials")
        done = tuning.evaluate(parts, trials).drop("position")
        done.write.mode("append").parquet(path)
        study, count, first = load_study(spark, path), count + size, first + size
    placed = positions(study.drop("position"), [F.round("score", 9).desc(), "trial_id"], "position")
    return placed.withColumn("position", (F.col("position") + 1).cast("int")).orderBy("position")
