import math
import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import pruning, ranking, similarity, tfidf, tuning
from labelloom.operators.ranking import Weights
from labelloom.plans import classify, joins
from labelloom.plans.classify import Settings


def companies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "company_id long, combined_features string")


def labels(spark, *texts):
    rows = [(i, t, t.lower()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "label_id long, label string, cleaned_label string")


def test_cosine(spark):
    c, l = companies(spark, "aa bb", "cc"), labels(spark, "bb")
    got = classify.cosine(c, l).collect()
    assert [(r["company_id"], r["label_id"]) for r in got] == [(0, 0)]
    assert got[0]["score"] == pytest.approx(0.473630, abs=1e-6)


def test_common_term_is_pruned(spark):
    assert classify.cosine(companies(spark, "aa bb"), labels(spark, "bb")).count() == 0


def test_idf(spark):
    counts = tfidf.term_counts(companies(spark, "aa bb", "bb"), "company_id", "combined_features")
    vocab = tfidf.vocabulary(tfidf.document_frequency(counts), 3)
    idf = {r["term"]: r["idf"] for r in vocab.collect()}
    assert idf["aa"] == pytest.approx(1.693147, abs=1e-6)
    assert idf["bb"] == pytest.approx(1.287682, abs=1e-6)


def test_one_letter_tokens_go_before_ngrams(spark):
    counts = tfidf.term_counts(companies(spark, "aa b cc"), "company_id", "combined_features")
    assert {r["term"] for r in counts.collect()} == {"aa", "cc", "aa cc"}


def test_weigh_is_the_same_beyond_the_broadcast_bound(spark, monkeypatch):
    texts = ["common " + " ".join(f"w{i % m}" for m in (2, 3, 5, 7)) + f" only{i}" for i in range(60)]
    c, l = companies(spark, *texts), labels(spark, "w1 common", "only3 w2")
    def run(own):
        counts = tfidf.term_counts(c, "company_id", "combined_features")
        vocab = tfidf.vocabulary(tfidf.document_frequency(counts), 60, max_df=0.9)
        rows = tfidf.unit_vectors(counts, "company_id", vocab, own).collect()
        return {(r["company_id"], r["term"]): round(r["weight"], 9) for r in rows}
    want = run(True)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(tfidf, "HOT_KEYS", 20)
    assert run(True) == want and run(False) == want
    monkeypatch.setattr(tfidf, "FILTER_BITS", 64)  # a filter that takes many terms for repeated ones
    assert run(True) == want
    assert ("common" in {t for _, t in want}) is False


def test_term_filter_forgets_no_term(spark):
    terms = spark.range(0, 5000, 2).select(F.concat(F.lit("t"), "id").alias("term"))
    blocks, size = tfidf.term_filter(terms, 2500)
    every = spark.range(5000).select("id", F.concat(F.lit("t"), "id").alias("term"))
    bits = {r["id"]: r["bit"] for r in tfidf.with_filter_bit(every, blocks, size, "bit").collect()}
    assert all(bits[i] for i in range(0, 5000, 2))
    assert sum(bits[i] for i in range(1, 5000, 2)) < 500


def _texts(rng, n, words, pool):
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(0, words))) for _ in range(n)]


@pytest.mark.parametrize("seed", [3])
@pytest.mark.parametrize("top_k,threshold", [(1, 0.3), (3, 0.05), (2, -1.0)])
def test_pruned_join_ranks_like_the_full_join(spark, seed, top_k, threshold):
    rng = random.Random(seed)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(80)]
    c = companies(spark, *_texts(rng, 40, 30, pool), "w1 w1 w1", "")
    l = labels(spark, *_texts(rng, 25, 8, pool), "w1 w2", "w1 w2")
    full = {}
    for r in classify.cosine(c, l).collect():
        full.setdefault(r["company_id"], []).append((round(r["score"], 9), r["label_id"]))
    want = {
        (i, label, place + 1): score
        for i, pairs in full.items()
        for place, (score, label) in enumerate(sorted(pairs, reverse=True)[:top_k]) if score >= threshold
    }
    _, matches = classify.top_matches(c, l, top_k=top_k, threshold=threshold)
    rows = matches.where("score > 0").collect()
    got = {(r["company_id"], r["label_id"], r["rank"]): r["score"] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)


def test_pruning_forms_fewer_pairs(spark):
    rng = random.Random(1)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)]
    c, l = companies(spark, *_texts(rng, 60, 40, pool)), labels(spark, *_texts(rng, 60, 8, pool))
    rows, postings, norms = classify.tfidf_features(c, l)
    grams = rows.where("kind = 'gram'").select("company_id", "term", "w")
    bounds = pruning.term_bounds(postings, 2)
    terms = pruning.bounded_terms(grams, norms, bounds, "company_id", 0.4)
    formed = pruning.partial_sums(terms, postings, "company_id").count()
    assert 0 < formed < 0.7 * classify.cosine(c, l).count()


@pytest.mark.parametrize("a,b,want", [
    (["a", "b"], ["a"], 0.5), (["a", "b", "c"], ["a", "b"], 0.8333333), (["a"], ["a"], 1.0),
])
def test_boosted_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    j = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    assert df.select(similarity.boosted(j).alias("s")).first()["s"] == pytest.approx(want)


def test_exact_bonus(spark):
    c = companies(spark, "pet boarding service dog", "other words")
    _, pairs = classify.ensemble_pairs(c, labels(spark, "Pet Boarding Services"))
    assert [round(r["bonus"], 9) for r in pairs.collect()] == [0.2]


def test_sector_fallback(spark):
    c = spark.createDataFrame(
        [(1, "Retail", "pet grooming"), (2, None, None), (3, "zzz", "x")],
        "company_id long, sector string, niche string",
    )
    got = similarity.sector_fallback(c, labels(spark, "Tree Services", "Pet Grooming Services")).collect()
    assert [(r["company_id"], r["label"], r["score"]) for r in got] == [(1, "Pet Grooming Services", 0.5)]


def test_weights():
    assert Weights(1, 1, 2).normalized() == Weights(0.25, 0.25, 0.5)
    assert Weights(0, 0, 0).normalized() == Weights(0, 0, 0)


def test_rescale_and_threshold(spark):
    df = spark.createDataFrame([(1, 0, 0.4), (1, 1, 0.2), (1, 2, 0.05)], "id int, label_id long, raw_score double")
    top = ranking.rescale(ranking.top_k_pairs(df, ["id"], "raw_score", 3), ["id"])
    got = top.orderBy("rank").collect()
    assert [round(r["score"], 6) for r in got] == [1.0, 0.25, 0.015625]
    assert top.where(ranking.at_least("score", 0.05)).count() == 2


def test_ties_go_to_the_last_label(spark):
    c, l = companies(spark, "aa", "zz"), labels(spark, "aa", "bb", "aa")
    out = classify.tfidf_classify(c, l, top_k=1).orderBy("company_id").collect()
    _, m = classify.top_matches(c, l, top_k=1)
    assert [r["label_id"] for r in m.collect()] == [2]
    assert out[1]["insurance_label"] == "Unclassified" and out[1]["insurance_labels"] == []


def test_ensure_one_tag(spark):
    c, l = companies(spark, "aa", "", None), labels(spark, "aa", "bb", "cc")
    out = {r["company_id"]: r for r in classify.ensemble_classify(c, l).collect()}
    assert out[0]["insurance_labels"] == ["aa"] and out[0]["insurance_label_scores"] == [1.0]
    assert out[1]["insurance_labels"] == ["cc"] and out[1]["insurance_label_scores"] == [0.0]
    assert len(out) == 3
    loose = classify.ensemble_classify(c, l, Settings(ensure_one_tag=False)).collect()
    assert {r["company_id"]: r["insurance_label"] for r in loose}[1] == "Unclassified"


def test_documented_fallback_chain(spark):
    c = spark.createDataFrame(
        [(1, "", "pet shop"), (2, "", None)], "company_id long, combined_features string, sector string"
    )
    s = Settings(require_positive_best=True)
    out = {r["company_id"]: r for r in classify.ensemble_classify(c, labels(spark, "Trees", "Pet Care"), s).collect()}
    assert out[1]["insurance_labels"] == ["Pet Care"]
    assert out[2]["insurance_labels"] == ["General Insurance"] and out[2]["insurance_label_scores"] == [0.1]
    named = classify.ensemble_classify(c, labels(spark, "Insurance in General", "x"), s).collect()
    assert {r["company_id"]: r["insurance_label"] for r in named}[2] == "Insurance in General"


def test_zero_threshold_pads_with_zero_scores(spark):
    c, l = companies(spark, "aa", ""), labels(spark, "aa", "bb", "cc")
    out = {r["company_id"]: r for r in classify.tfidf_classify(c, l, top_k=2, threshold=0.0).collect()}
    assert out[0]["insurance_labels"] == ["aa", "cc"]
    assert out[1]["insurance_labels"] == ["cc", "bb"]


def test_arguments_are_checked(spark):
    c, l = companies(spark, "aa"), labels(spark, "aa")
    with pytest.raises(ValueError):
        classify.tfidf_classify(c, l, top_k=0)
    with pytest.raises(ValueError):
        classify.tfidf_classify(c, l, text="missing")
    with pytest.raises(ValueError):
        classify.ensemble_classify(c, l.drop("cleaned_label"))


@pytest.mark.parametrize("mode", ["optimized", "basic"])
def test_combined_columns_score_like_the_combined_text(spark, mode):
    from labelloom.operators import features

    rows = [
        (1, "pet boarding dog", "real", "estate office"), (2, "car", "", "truck fleet"),
        (3, "a b", None, "data breach of the privacy"), (4, "", "", ""),
        (5, "commercial", "auto", "x"), (6, "long words only here again", "dog", "pet"),
    ]
    df = spark.createDataFrame(rows, "company_id long, a string, b string, c string")
    repeats = {"a": 10, "b": 15, "c": 20}
    l = labels(spark, "Pet Boarding", "Real Estate Office", "Commercial Auto", "Data Privacy")
    s = Settings(mode=mode)
    plain = df.withColumn("combined_features", features.combined_text(repeats))
    def result(*args, **options):
        out = classify.ensemble_classify(*args, **options).collect()
        return sorted((r["company_id"], r["insurance_labels"], [round(x, 9) for x in r["insurance_label_scores"]]) for r in out)
    assert result(df, l, s, repeats=repeats) == result(plain, l, s)


def test_result_does_not_depend_on_partitioning(spark):
    texts = [f"pet dog w{i % 7} office w{i % 3}" for i in range(40)]
    c, l = companies(spark, *texts), labels(spark, "Pet w1", "Dog w2", "Office w3 w4")
    def result(df):
        return sorted((r["company_id"], r["insurance_label"]) for r in classify.ensemble_classify(df, l).collect())
    assert result(c) == result(c.repartition(13).orderBy(F.desc("company_id")))


def test_objective(spark):
    df = spark.createDataFrame(
        [(1, ["a", "b"], [1.0, 0.5]), (1, ["a"], [1.0])],
        "trial_id long, insurance_labels array<string>, insurance_label_scores array<double>",
    )
    row = tuning.objective(df, 4).first()
    assert row["score"] == pytest.approx(0.85)


def test_search_space_is_repeatable(spark):
    a = tuning.search_space(spark, 30).orderBy("trial_id").collect()
    assert a == tuning.search_space(spark, 30).repartition(3).orderBy("trial_id").collect()
    for r in a:
        assert 1 <= r["top_k"] <= 10 and 0.01 <= r["threshold"] <= 0.3
        assert math.isclose(r["tfidf_weight"] + r["wordnet_weight"] + r["keyword_weight"], 1.0)


def test_result_is_the_same_beyond_the_broadcast_bound(spark, monkeypatch):
    texts = [f"pet dog w{i % 7} office w{i % 3}" for i in range(40)]
    c, l = companies(spark, *texts), labels(spark, "Pet w1", "Dog w2", "Office w3 w4", "Real Estate")
    def result():
        out = classify.ensemble_classify(c, l).collect()
        return sorted((r["company_id"], r["insurance_labels"], [round(s, 9) for s in r["insurance_label_scores"]]) for r in out)
    want = result()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(joins, "HOT_KEYS", 50)
    monkeypatch.setattr(tfidf, "HOT_KEYS", 50)
    assert result() == want


@pytest.mark.parametrize("top_k", [1, 2, 5, 50])
@pytest.mark.parametrize("threshold", [0.0, 0.05])
def test_pruned_pairs_give_the_same_ranks(spark, top_k, threshold):
    sectors = {"s1": ["alpha"], "s2": ["beta"], "s3": ["gamma"]}
    words = ["alpha", "beta", "gamma", "tree", "pet", "shop"]
    companies = spark.createDataFrame(
        [(i, " ".join(w for j, w in enumerate(words) if (i * 37 + 11) >> j & 1)) for i in range(40)],
        "company_id long, combined_features string",
    )
    names = [" ".join(w for j, w in enumerate(words) if i >> j & 1) for i in range(1, 40)]
    labels = spark.createDataFrame(
        [(i, f"label{i} {n}", n) for i, n in enumerate(names)], "label_id long, label string, cleaned_label string"
    )
    settings = Settings(top_k=top_k, threshold=threshold, sector_lexicon=sectors)
    rows, full = classify.ensemble_pairs(companies, labels, settings)
    _, pruned = classify.ensemble_pairs(companies, labels, settings, best=top_k)

    def ranks(pairs):
        scored = ranking.ensemble_score(pairs, settings.weights)
        out = ranking.top_k_pairs(scored, ["company_id"], "raw_score", top_k)
        return sorted((r["company_id"], r["rank"], r["label_id"], round(r["raw_score"], 9)) for r in out.collect())

    assert ranks(pruned) == ranks(full)
    assert pruned.count() <= full.count()


def test_checks_of_a_size_need_no_single_partition(spark):
    from labelloom.plans import joins

    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(7).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert joins.fits_broadcast(small) and not joins.fits_broadcast(small, rows=3)
    old = joins.BROADCAST_ROWS
    joins.BROADCAST_ROWS = 3
    try:
        assert joins.lookup_join(big, small, ["k"], "id").count() == 1000
    finally:
        joins.BROADCAST_ROWS = old
