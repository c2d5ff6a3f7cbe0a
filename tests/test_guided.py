"""Guided search: densities, proposals, resuming; agreement with given labels."""

import math
import random

import pytest

from labelloom.operators import guided, tuning
from labelloom.plans.classify import Settings


def study(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t, w, k = (rng.uniform(0.1, 1) for _ in range(3))
        top, threshold, total = rng.randint(1, 10), rng.uniform(0.01, 0.3), t + w + k
        rows.append((i, top, threshold, t / total, w / total, k / total, 1 - abs(threshold - 0.08) * 3 - abs(top - 3) / 20))
    return rows, spark.createDataFrame(rows, tuning.TRIAL_SCHEMA + ", score double")


def test_densities_equal_the_plain_sums(spark):
    rows, history = study(spark, 12)
    spans = guided.ranges(spark)
    points = spark.createDataFrame([(i, "threshold", 0.03 * i) for i in range(8)], "point int, parameter string, x double")
    got = {r["point"]: r for r in guided.densities(points, guided.observations(history, 0.25), spans, ["point"]).collect()}
    ranked = sorted(rows, key=lambda r: (-round(r[6], 9), r[0]))
    for name, group in (("good", ranked[:3]), ("bad", ranked[3:])):
        values = [r[2] for r in group]
        mean = sum(values) / len(values)
        width = max(math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) * len(values) ** -0.2, 0.29 / 50)
        for i in range(8):
            sums = sum(math.exp(-(((0.03 * i - v) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi)) for v in values)
            assert got[i][name] == pytest.approx((1 / 0.29 + sums) / (len(values) + 1))


def test_proposals_follow_the_good_trials(spark):
    _, history = study(spark)
    trials = spark.range(100, 160).withColumnRenamed("id", "trial_id")
    rows = guided.propose(history, trials).collect()
    assert sorted(map(tuple, guided.propose(history, trials.repartition(7)).collect())) == sorted(map(tuple, rows))
    assert len(rows) == 60 and {r["trial_id"] for r in rows} == set(range(100, 160))
    assert all(1 <= r["top_k"] <= 10 and 0.01 <= r["threshold"] <= 0.3 for r in rows)
    assert all(r["tfidf_weight"] + r["wordnet_weight"] + r["keyword_weight"] == pytest.approx(1) for r in rows)
    near = sum(abs(r["threshold"] - 0.08) < 0.05 for r in rows) / 60
    assert near > 0.7  # a third of random ones would be


def test_proposals_from_one_trial(spark):
    _, history = study(spark, 1)
    assert guided.propose(history, spark.range(5, 7).withColumnRenamed("id", "trial_id")).count() == 2


def tables(spark):
    texts = ["pet boarding and care", "tree care", "boat hire", "boat and pet hire", "water supply", "pet food"]
    companies = spark.createDataFrame(list(enumerate(texts)), "company_id long, combined_features string")
    labels = [(i, t, t) for i, t in enumerate(["pet care", "tree services", "boat hire", "water"])]
    return companies, spark.createDataFrame(labels, "label_id long, label string, cleaned_label string")


def test_a_resumed_search_equals_an_uninterrupted_one(spark, tmp_path):
    companies, labels = tables(spark)
    run = lambda path, n, block: guided.search(
        companies, labels, str(tmp_path / path), n, block, startup=4, settings=Settings(sector_lexicon={})
    )
    whole = [tuple(r) for r in run("one", 8, 2).collect()]
    run("two", 3, 1)
    run("two", 1, 5)
    assert run("two", 0, 1).count() == 4
    again = [tuple(r) for r in run("two", 4, 2).collect()]
    assert again == whole and len(whole) == 8
    assert sorted(r[0] for r in whole) == list(range(8))
    ended = guided.search(companies, labels, str(tmp_path / "one"), 50, seconds=1e-9, settings=Settings(sector_lexicon={}))
    assert [tuple(r) for r in ended.collect()] == whole


def test_annotated_objective(spark):
    guessed = [(1, 10, ["a", "b", "a"]), (1, 11, []), (1, 12, ["c"]), (1, 13, ["a"]), (2, 10, None), (2, 11, ["b"]), (3, 13, ["a"])]
    given = [(10, "a"), (10, "a"), (11, "b"), (12, "d"), (12, None), (99, "z")]
    got = tuning.annotated_objective(
        spark.createDataFrame(guessed, "trial_id long, company_id long, insurance_labels array<string>"),
        spark.createDataFrame(given, "company_id long, label string"),
    )
    rows = {r["trial_id"]: tuple(round(v, 6) for v in r[1:]) for r in got.collect()}
    # trial 1: a right, b and c wrong, b and d missed; trial 2: b right, a missed; trial 3: nothing annotated
    assert rows[1] == (round(1 / 3, 6), round(1 / 3, 6), round(1 / 3, 6), 0.25, 0.25, 0.25)
    assert rows[2] == (1.0, 0.5, round(2 / 3, 6), 0.5, 0.5, 0.5)
    assert rows[3] == (0.0,) * 6
