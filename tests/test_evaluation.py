import random
import statistics

import pytest
from pyspark.sql import functions as F

from labelloom.operators import evaluation, evaluation as E, evaluation_state
from labelloom.sources import sinks


def table(spark, rows):
    return spark.createDataFrame(
        rows, "company_id long, insurance_labels array<string>, insurance_label_scores array<double>"
    )


def test_companies_per_label(spark):
    df = table(spark, [(1, ["Welding Services"], [1.0]), (2, ["Field Welding Services"] * 2, [1.0, 1.0])])
    got = {r["label"]: (r["assignments"], r["companies"]) for r in E.label_counts(df).collect()}
    assert got == {"Welding Services": (1, 1), "Field Welding Services": (2, 1)}


def test_summary_and_histogram(spark):
    df = table(spark, [(1, ["a", "b"], []), (2, [], []), (3, None, None), (4, list("abcde"), [])])
    s = E.summary(df).first()
    assert (s["total_companies"], s["companies_with_labels"], s["coverage_percentage"]) == (4, 2, 50.0)
    assert (s["total_labels_assigned"], s["unique_labels_used"], s["avg_labels_per_company"]) == (7, 5, 1.75)
    assert [tuple(r) for r in E.label_histogram(df).collect()] == [
        ("0", 2), ("1", 0), ("2", 1), ("3", 0), ("4+", 1)
    ]
    empty = E.summary(df.limit(0)).first()
    assert empty["coverage_percentage"] == 0.0 and empty["avg_labels_per_company"] == 0.0


def test_scores(spark):
    df = table(spark, [(1, [], [1.0, 2.0]), (2, [], [4.0, 9.0])])
    assert E.score_stats(df).first()["median_score"] == 3.0
    assert E.score_stats(df.limit(0)).count() == 0
    bins = {r["score_range"]: r["assignments"] for r in E.score_histogram(table(spark, [(1, [], [0.1, 1.0, 1.2])])).collect()}
    assert bins.pop("0.1-0.2") == 1 and bins.pop("0.9-1.0") == 1
    assert set(bins.values()) == {0} and len(bins) == 8


@pytest.mark.parametrize("seed", range(4))
def test_median_by_narrowing(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([1.0, rng.random() ** 4, round(rng.random(), 1)]) for _ in range(401 + seed)]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    assert E.exact_median(df, "score", slices=7, small=3) == statistics.median(values)


def test_report(spark):
    df = table(spark, [(1, ["a"], [0.5]), (2, [], [])])
    sections = {r["section"] for r in E.evaluation_report(df).collect()}
    assert sections == {
        "general", "labels_per_company", "top_labels", "bottom_labels", "companies_per_label",
        "scores", "score_ranges",
    }
    assert {r["chart"] for r in E.chart_data(df).collect()} == {"top_labels", "labels_per_company", "score_ranges"}


def test_merged_states_report_like_the_union(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        n = rng.choice([0, 0, 1, 2, 3, 5, None])
        names = None if n is None else [rng.choice("abcdefghijklm") for _ in range(n)]
        scores = None if n is None else [rng.choice([0.0, 0.25, 1.0, rng.random(), 1.5]) for _ in range(n)]
        rows.append((i, names, scores))
    df = spark.createDataFrame(rows, "company_id long, insurance_labels array<string>, insurance_label_scores array<double>")
    path = str(tmp_path / "states")
    evaluation_state.save_state(df.where("company_id < 5"), path, "b")
    for run, part in (("a", "company_id < 100"), ("b", "company_id BETWEEN 100 AND 180"), ("c", "company_id > 180"), ("d", "false")):
        evaluation_state.save_state(df.where(part), path, run)

    def report(out):
        return sorted((r["section"], r["metric"], round(r["value"], 9)) for r in out.collect())

    assert report(evaluation_state.report(evaluation_state.load_state(spark, path))) == report(evaluation.evaluation_report(df))
    two = evaluation_state.load_state(spark, path, "a", "b")
    assert report(evaluation_state.report(two)) == report(evaluation.evaluation_report(df.where("company_id <= 180")))
    bare = df.drop("insurance_label_scores")
    assert report(evaluation_state.report(evaluation_state.state(bare))) == report(evaluation.evaluation_report(bare))
    nothing = evaluation_state.report(evaluation_state.state(df.where("false"))).where("section = 'general'")
    assert {r["value"] for r in nothing.collect()} == {0.0}


@pytest.mark.parametrize("score,text", [(0.03125, "0.0312"), (0.09375, "0.0938"), (0.00125, "0.0013"), (1.0, "1.0000"), (0.99995, "1.0000"), (0.0, "0.0000")])
def test_scores_are_written_as_python_rounds_them(spark, score, text):
    assert text == f"{score:.4f}"
    df = spark.createDataFrame([(score,)], "x double")
    assert df.select(sinks.four_decimals(F.col("x")).alias("t")).first()["t"] == text
