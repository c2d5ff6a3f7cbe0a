import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import features, lexicon, lexicon as lex, tfidf
from labelloom.plans import classify, joins, preprocess
from labelloom.plans.classify import Settings


def test_combined_text(spark):
    df = spark.createDataFrame([(1, "ab", " ", "cd")], "id int, d string, t string, s string")
    text = df.select(features.combined_text({"d": 10, "t": 15, "s": 20}).alias("r")).first()["r"]
    assert text == " ".join(["ab"] * 10 + ["cd"] * 20)


def test_combined_counts_equal_plain_counts(spark):
    rng = random.Random(7)
    def text():
        return " ".join(rng.choice(["aa", "bb", "cc", "d", "ee"]) for _ in range(rng.randrange(6)))
    rows = [(i, text(), text(), text() if i % 4 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    repeats = {"a": 2, "b": 3, "c": 5}
    fast = features.combined_term_counts(df, "id", repeats)
    plain = tfidf.term_counts(df.withColumn("x", features.combined_text(repeats)), "id", "x")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, plain.collect()))
    with pytest.raises(ValueError):
        features.combined_term_counts(df, "id", {"a": 1})


def test_size_category(spark):
    values = [-1.0, 9.0, 10.0, 49.5, 50.0, 249.0, 250.0, 999.0, 1000.0, None]
    df = spark.createDataFrame([(v,) for v in values], "employees double")
    got = [r["size_category"] for r in features.size_category(df).collect()]
    assert got == [
        "Micro", "Micro", "Small", "Unknown", "Medium", "Medium", "Large", "Large",
        "Enterprise", "Unknown",
    ]
    assert "size_category" not in features.size_category(df, "missing").columns


def test_location(spark):
    places = ["Paris, France", "Austin, TX, USA", "A, B, C, D", "Paris", None]
    df = spark.createDataFrame([(p,) for p in places], "p string")
    got = [(r["city"], r["state"], r["country"]) for r in features.normalize_location(df, "p").collect()]
    assert got == [
        ("Paris", None, "France"), ("Austin", "TX", "USA"), ("A", "B", "C, D"),
        ("Paris", None, None), (None, None, None),
    ]


def test_industry_keywords(spark):
    df = spark.createDataFrame([("Health and life-science", ), (None,)], "t string")
    rows = features.industry_keywords(df, "t").collect()
    assert rows[0]["detected_industries"] == ["life", "health"] and rows[0]["is_health"] == 1
    assert rows[1]["detected_industries"] == [] and rows[1]["is_health"] == 0
    custom = features.industry_keywords(df, "t", ["life-science", "and"]).first()
    assert custom["detected_industries"] == ["life-science", "and"]


def test_synonyms(spark):
    syn = spark.createDataFrame(
        [("dog", 1, 1, "dog"), ("dog", 1, 2, "domestic_dog"), ("dog", 1, 4, "far"),
         ("dog", 2, 1, "cat"), ("dog", 3, 1, "late")],
        "term string, synset_rank int, lemma_rank int, lemma string",
    )
    df = spark.createDataFrame([(1, ["dog", "cat", "dog house"])], "id int, t array<string>")
    assert lexicon.expand_synonyms(df, "id", "t", syn).first()["synonyms"] == [
        "dog", "cat", "dog house", "domestic dog",
    ]
    assert lexicon.expand_synonyms_full(df, "id", "t", syn).first()["synonyms"] == [
        "dog", "cat", "dog house", "domestic dog", "far", "late",
    ]


def test_sectors(spark):
    df = spark.createDataFrame([("office real estate carpet",), ("",), (None,)], "t string")
    opt = [r["s"] for r in lexicon.with_sectors(df, "t", "s").collect()]
    assert opt == [["property"], [], []]
    basic = [r["s"] for r in lexicon.with_sectors(df, "t", "s", "basic").collect()]
    assert basic[0] == ["property", "auto", "specialty"]  # car and pet in carpet


def test_preprocess_skips_missing_columns(spark):
    df = spark.createDataFrame([("p1", "GL policies")], "company_id string, sector string")
    out = preprocess.preprocess_companies(df)
    assert out.columns == ["company_id", "sector", "cleaned_sector", "combined_features"]


def test_lookup_join_beyond_the_broadcast_bound(spark, monkeypatch):
    big = spark.range(4000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k")
    )
    small = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = {h: sorted(map(tuple, joins.lookup_join(big, small, ["k"], "id", h).collect())) for h in ("inner", "left")}
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(joins, "HOT_KEYS", 100)
    for how, rows in want.items():
        out = joins.lookup_join(big, small, ["k"], "id", how)
        assert sorted(map(tuple, out.collect())) == rows
    assert joins.hot_keys(big, ["k"]).count() == 1


def test_sector_masks_of_a_wide_lexicon(spark):
    wide = {f"s{i}": [f"word{i}x"] for i in range(150)}
    texts = ["word0x word61x word62x word149x", "word62x", "nothing", None]
    df = spark.createDataFrame(list(enumerate(texts)), "company_id long, t string")
    for lexicon, want in ((wide, [{0, 61, 62, 149}, {62}, set(), set()]), ({}, [set()] * 4)):
        rows = lex.with_sector_masks(df, "t", "m", "basic", lexicon).select("company_id", lex.mask_bits(F.col("m")).alias("bits"), lex.mask_key(F.col("m")).alias("key"))
        got = {r["company_id"]: r for r in rows.collect()}
        assert [set(got[i]["bits"]) for i in range(4)] == want
        assert [got[i]["key"] == "" for i in range(4)] == [not w for w in want]


@pytest.mark.parametrize("sectors", [5, 130])
def test_sector_scores_equal_sets_of_names(spark, sectors):
    rng = random.Random(sectors)
    lexicon = {f"s{i}": [f"key{i}z"] for i in range(sectors)}
    sets = lambda n: [rng.sample(range(sectors), rng.randint(0, 4)) for _ in range(n)]
    c, l = sets(25), sets(25)
    text = lambda s: " ".join(f"key{i}z" for i in s)
    companies = spark.createDataFrame([(i, text(s)) for i, s in enumerate(c)], "company_id long, combined_features string")
    labels = spark.createDataFrame([(i, text(s), text(s)) for i, s in enumerate(l)], "label_id long, label string, cleaned_label string")
    _, pairs = classify.ensemble_pairs(companies, labels, Settings(sector_lexicon=lexicon))
    got = {(r["company_id"], r["label_id"]): r["keyword"] for r in pairs.collect() if r["keyword"] > 0}
    want = {}
    for i, a in enumerate(c):
        for j, b in enumerate(l):
            if both := set(a) & set(b):
                share = len(both) / len(set(a) | set(b))
                want[i, j] = 0.5 + share * 0.5 if share > 0.5 else share
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
