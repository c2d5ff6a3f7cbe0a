"""Statistics of a classified table.

Input: one row per company with ``insurance_labels`` and, for score statistics,
``insurance_label_scores``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions.arrays import unnest
from labelloom.operators.features import require_columns
from labelloom.plans.scratch import materialize

# Histogram buckets.
LABEL_BUCKETS = ["0", "1", "2", "3", "4+"]
SCORE_EDGES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]

def _labels() -> Column:
    return F.coalesce(F.size("insurance_labels"), F.lit(0))


def _share(part: Column, whole: Column, factor: float = 1.0) -> Column:
    return F.coalesce(F.try_divide(part * factor, whole), F.lit(0.0))


def _unpivot(df: DataFrame, name: str, value: str, items: dict[str, Column]) -> DataFrame:
    """One row per aggregate; empty buckets stay because nothing is grouped."""
    totals = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(items.values())])
    rows = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(k).alias(name), F.col(f"c{i}").alias(value))
        for i, k in enumerate(items)
    ])
    return totals.select(F.inline(rows)).drop("pos")


def label_counts(df: DataFrame) -> DataFrame:
    """``(label, assignments, companies)``.  Repeats inside one company's list
    count as assignments, not as companies."""
    require_columns(df, "insurance_labels")
    per_company = F.transform(
        F.array_distinct("insurance_labels"),
        lambda x: F.struct(
            x.alias("label"),
            F.size(F.filter("insurance_labels", lambda y: y == x)).alias("n"),
        ),
    )
    return (
        df.select(F.inline(per_company))
        .groupBy("label")
        .agg(F.sum("n").alias("assignments"), F.count(F.lit(1)).alias("companies"))
    )


def summary(df: DataFrame) -> DataFrame:
    """One row: totals, coverage, averages, unique labels."""
    zero = F.lit(0).cast("bigint")
    companies = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_labels() > 0).alias("labeled"),
        F.coalesce(F.sum(_labels()), F.lit(0)).alias("assigned"), zero.alias("unique"),
    )
    labels = label_counts(df).agg(
        zero.alias("total"), zero.alias("labeled"), zero.alias("assigned"),
        F.count(F.lit(1)).alias("unique"),
    )
    both = companies.unionByName(labels).agg(*[F.sum(c).alias(c) for c in companies.columns])
    total, labeled, assigned = F.col("total"), F.col("labeled"), F.col("assigned")
    return both.select(
        total.alias("total_companies"),
        labeled.alias("companies_with_labels"),
        (total - labeled).alias("companies_without_labels"),
        _share(labeled, total, 100.0).alias("coverage_percentage"),
        assigned.alias("total_labels_assigned"),
        _share(assigned, total, 1.0).alias("avg_labels_per_company"),
        F.col("unique").alias("unique_labels_used"),
    )


def label_histogram(df: DataFrame) -> DataFrame:
    counts = {b: F.count_if(_labels() == int(b)) for b in LABEL_BUCKETS[:-1]}
    counts[LABEL_BUCKETS[-1]] = F.count_if(_labels() >= len(LABEL_BUCKETS) - 1)
    return _unpivot(df, "labels", "companies", counts)


def top_labels(df: DataFrame, n: int = 10) -> DataFrame:
    return label_counts(df).orderBy(F.desc("assignments"), "label").limit(n).select("label", "assignments")


def bottom_labels(df: DataFrame, n: int = 10) -> DataFrame:
    return label_counts(df).orderBy("assignments", "label").limit(n).select("label", "assignments")


def assignment_stats(df: DataFrame) -> DataFrame:
    return summary(df).select(
        "total_companies",
        F.col("total_labels_assigned").alias("total_label_assignments"),
        F.col("unique_labels_used").alias("unique_labels"),
        "avg_labels_per_company",
    )


def coverage(df: DataFrame) -> DataFrame:
    total, labeled = F.count(F.lit(1)), F.count_if(_labels() > 0)
    return df.agg(
        total.alias("total_companies"),
        labeled.alias("companies_with_labels"),
        (total - labeled).alias("companies_without_labels"),
        _share(labeled, total, 100.0).alias("coverage_percentage"),
    )


# --- scores ----------------------------------------------------------------

def scores(df: DataFrame) -> DataFrame:
    require_columns(df, "insurance_label_scores")
    return unnest(df, [], F.col("insurance_label_scores"), "score")


def exact_median(values: DataFrame, column: str, slices: int = 2000, small: int = 20_000) -> float | None:
    """Median by narrowing, so no task ever holds all values.

    Values are first counted per distinct value.  Each round counts ``slices``
    equal ranges and keeps the ones that hold the middle positions, until few
    distinct values are left.
    """
    v = F.col("v")
    counted = values.select(F.col(column).alias("v")).where(v.isNotNull()).groupBy("v").agg(
        F.count(F.lit(1)).alias("n")
    )
    return median_of_counts(materialize(counted, "score_counts"), slices, small)


def median_of_counts(counted: DataFrame, slices: int = 2000, small: int = 20_000) -> float | None:
    """``exact_median`` of values ``v`` that occur ``n`` times each."""
    v = F.col("v")
    total = counted.agg(F.sum("n")).first()[0]
    if not total:
        return None
    below = 0
    middle = ((total - 1) // 2, total // 2)
    while True:
        low, high, distinct = counted.agg(F.min("v"), F.max("v"), F.count("v")).first()
        if distinct <= small or low == high:
            break
        place = F.least(
            F.floor((v - low) / (high - low) * slices), F.lit(slices - 1)
        )
        ranges = (
            counted.groupBy(place.alias("p"))
            .agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("p").collect()
        )
        seen, kept = below, []
        for r in ranges:
            if seen <= middle[1] and seen + r["n"] > middle[0]:
                kept.append((seen, r["lo"], r["hi"]))
            seen += r["n"]
        if len(kept) > 1:
            # the middle lies between two ranges
            return (kept[0][2] + kept[-1][1]) / 2
        below = kept[0][0]
        counted = counted.where(v.between(kept[0][1], kept[0][2]))
    at, found = below, []
    # at most ``small`` values are left by now, so the limit cuts none of them
    for r in counted.orderBy("v").limit(small).collect():
        found += [float(r["v"]) for m in middle if at <= m < at + r["n"]]
        at += r["n"]
    return (found[0] + found[-1]) / 2


def score_stats(df: DataFrame) -> DataFrame:
    """Mean, median, minimum, maximum; no row when there are no scores."""
    rows = scores(df)
    median = exact_median(rows, "score")
    return rows.agg(
        F.count("score").alias("_n"),
        F.avg("score").alias("avg_score"),
        F.lit(median).cast("double").alias("median_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    ).where(F.col("_n") > 0).drop("_n")


def score_histogram(df: DataFrame) -> DataFrame:
    """Ten bins, closed below, the last one closed; other scores are dropped."""
    s = F.col("score")
    bins = {}
    for lo, hi in zip(SCORE_EDGES, SCORE_EDGES[1:]):
        inside = (s >= lo) & (s < hi)
        if hi == 1.0:
            inside = inside | (s == 1.0)
        bins[f"{lo}-{hi}"] = F.count_if(inside)
    return _unpivot(scores(df), "score_range", "assignments", bins)


# --- reports ---------------------------------------------------------------

def section(name: str, rows: DataFrame) -> DataFrame:
    metric, value = rows.columns
    return rows.select(
        F.lit(name).alias("section"),
        F.col(metric).alias("metric"),
        F.col(value).cast("double").alias("value"),
    )


def wide(name: str, rows: DataFrame) -> DataFrame:
    """A section with one metric per column."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in rows.columns
    ])
    return section(name, rows.select(F.inline(cells)))


def evaluation_report(df: DataFrame, key: str = "company_id") -> DataFrame:
    """``(section, metric, value)`` of all statistics."""
    has_scores = "insurance_label_scores" in df.columns
    columns = [c for c in (key, "insurance_labels", "insurance_label_scores") if c in df.columns]
    # written once: every section reads it
    df = materialize(df.select(*columns), "classified")

    parts = [
        wide("general", summary(df)),
        section("labels_per_company", label_histogram(df)),
        section("top_labels", top_labels(df)),
        section("bottom_labels", bottom_labels(df)),
        section("companies_per_label", label_counts(df).select("label", "companies")),
    ]
    if has_scores:
        parts += [wide("scores", score_stats(df)), section("score_ranges", score_histogram(df))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def chart_data(df: DataFrame) -> DataFrame:
    """``(chart, x, y)`` of the three bar charts."""
    def chart(name: str, rows: DataFrame) -> DataFrame:
        x, y = rows.columns
        return rows.select(F.lit(name).alias("chart"), F.col(x).alias("x"), F.col(y).alias("y"))

    out = chart("top_labels", top_labels(df)).unionByName(
        chart("labels_per_company", label_histogram(df))
    )
    if "insurance_label_scores" in df.columns:
        out = out.unionByName(chart("score_ranges", score_histogram(df)))
    return out
