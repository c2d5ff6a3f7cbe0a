"""Evaluation of many runs from states that merge.

The state of a run is a table ``(kind, name, value, n)`` of counts:

``size``    companies by their number of labels
``label``   assignments of a label (``value`` 0) and companies that have it (1)
``score``   assignments by score

States of disjoint runs are added up row by row, so a report over all runs reads
their states and no classified table again; a run that is repeated replaces its own
state only.  The counts keep every distinct score, so the median of the union is
exact: it is found by narrowing ranges of values over the merged counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.operators import evaluation
from labelloom.operators.evaluation import section, wide
from labelloom.plans.scratch import materialize

_STATE = "kind string, name string, value double, n long"


def _rows(kind: str, rows: DataFrame, name, value, n) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.cast("double").alias("value"), n.cast("long").alias("n")
    )


def state(df: DataFrame) -> DataFrame:
    """The state of one classified table."""
    none = F.lit(None)
    sizes = df.select(evaluation._labels().alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    labels = evaluation.label_counts(df)
    parts = [
        _rows("size", sizes, none, F.col("size"), F.col("n")),
        _rows("label", labels, F.col("label"), F.lit(0), F.col("assignments")),
        _rows("label", labels, F.col("label"), F.lit(1), F.col("companies")),
    ]
    if "insurance_label_scores" in df.columns:
        scores = evaluation.scores(df).where("score IS NOT NULL").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
        parts.append(_rows("score", scores, none, F.col("score"), F.col("n")))
    return reduce(DataFrame.unionAll, parts)


def merge(*states: DataFrame) -> DataFrame:
    """The state of all runs together."""
    return reduce(DataFrame.unionAll, states).groupBy("kind", "name", "value").agg(F.sum("n").alias("n"))


def save_state(df: DataFrame, path: str, run: str) -> None:
    """Write the state of a classified table as that of ``run``."""
    state(df).write.mode("overwrite").parquet(f"{path}/run={run}")


def load_state(spark: SparkSession, path: str, *runs: str) -> DataFrame:
    """The merged state of the named runs, or of all."""
    stored = spark.read.schema(f"{_STATE}, run string").parquet(path)
    return merge(stored.where(F.col("run").isin(*runs)).drop("run") if runs else stored.drop("run"))


def _of(merged: DataFrame, kind: str) -> DataFrame:
    return merged.where(F.col("kind") == kind)


def summary(merged: DataFrame) -> DataFrame:
    """``evaluation.summary`` of the runs behind a state."""
    size, n = F.col("value"), F.col("n")
    is_size = F.col("kind") == "size"
    counts = merged.agg(
        F.coalesce(F.sum(F.when(is_size, n)), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(is_size & (size > 0), n)), F.lit(0)).alias("labeled"),
        F.coalesce(F.sum(F.when(is_size, size * n)), F.lit(0.0)).cast("long").alias("assigned"),
        F.count(F.when((F.col("kind") == "label") & (size == 1), 1)).alias("unique"),
    )
    total, labeled, assigned = F.col("total"), F.col("labeled"), F.col("assigned")
    return counts.select(
        total.alias("total_companies"),
        labeled.alias("companies_with_labels"),
        (total - labeled).alias("companies_without_labels"),
        evaluation._share(labeled, total, 100.0).alias("coverage_percentage"),
        assigned.alias("total_labels_assigned"),
        evaluation._share(assigned, total, 1.0).alias("avg_labels_per_company"),
        F.col("unique").alias("unique_labels_used"),
    )


def label_counts(merged: DataFrame) -> DataFrame:
    """``(label, assignments, companies)``."""
    count = lambda v: F.sum(F.when(F.col("value") == v, F.col("n")))
    return _of(merged, "label").groupBy(F.col("name").alias("label")).agg(
        count(0).alias("assignments"), count(1).alias("companies")
    )


def _histogram(rows: DataFrame, name: str, n: str, items: dict) -> DataFrame:
    sums = {k: F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)) for k, inside in items.items()}
    return evaluation._unpivot(rows, name, n, sums)


def label_histogram(merged: DataFrame) -> DataFrame:
    buckets = evaluation.LABEL_BUCKETS
    items = {b: F.col("value") == int(b) for b in buckets[:-1]}
    items[buckets[-1]] = F.col("value") >= len(buckets) - 1
    return _histogram(_of(merged, "size"), "labels", "companies", items)


def score_histogram(merged: DataFrame) -> DataFrame:
    s, edges = F.col("value"), evaluation.SCORE_EDGES
    items = {f"{lo}-{hi}": (s >= lo) & ((s < hi) | (F.lit(hi == 1.0) & (s == 1.0))) for lo, hi in zip(edges, edges[1:])}
    return _histogram(_of(merged, "score"), "score_range", "assignments", items)


def score_stats(merged: DataFrame) -> DataFrame:
    """Mean, median, minimum, maximum; no row when there are no scores."""
    counted = _of(merged, "score").select(F.col("value").alias("v"), "n")
    median = evaluation.median_of_counts(counted)
    n, v = F.col("n"), F.col("v")
    return counted.agg(
        F.sum(n).alias("_n"), (F.sum(n * v) / F.sum(n)).alias("avg_score"),
        F.lit(median).cast("double").alias("median_score"), F.min(v).alias("min_score"), F.max(v).alias("max_score"),
    ).where(F.col("_n") > 0).drop("_n")


def report(merged: DataFrame, n: int = 10) -> DataFrame:
    """``evaluation.evaluation_report`` of the runs behind a state."""
    merged = materialize(merged, "evaluation_state")
    labels = label_counts(merged)
    parts = [
        wide("general", summary(merged)),
        section("labels_per_company", label_histogram(merged)),
        section("top_labels", labels.orderBy(F.desc("assignments"), "label").limit(n).select("label", "assignments")),
        section("bottom_labels", labels.orderBy("assignments", "label").limit(n).select("label", "assignments")),
        section("companies_per_label", labels.select("label", "companies")),
    ]
    if _of(merged, "score").head(1):
        parts += [wide("scores", score_stats(merged)), section("score_ranges", score_histogram(merged))]
    return reduce(DataFrame.unionByName, parts)
