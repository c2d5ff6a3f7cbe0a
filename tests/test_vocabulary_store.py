"""Versions of document frequencies against a fit over all documents."""

import random

import pytest

from labelloom.operators import tfidf
from labelloom.plans import classify
from labelloom.sources import vocabulary_store as store


def docs(spark, texts):
    return spark.createDataFrame(list(texts), "company_id long, combined_features string")


def fit(spark, texts, max_df=0.9):
    d = docs(spark, texts)
    counts = tfidf.term_counts(d, "company_id", "combined_features")
    rows = tfidf.vocabulary(tfidf.document_frequency(counts), len(texts), max_df=max_df).collect()
    return {(r["term"], r["df"], r["idf"]) for r in rows}


def read(spark, path, version=None, max_df=0.9):
    vocab, n = store.vocabulary(spark, path, version, max_df=max_df)
    return {(r["term"], r["df"], r["idf"]) for r in vocab.collect()}, n


def test_versions_equal_a_fit_over_their_union(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "store")
    texts = [(i, " ".join(rng.choice("alpha beta gamma delta rho tau".split()) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    assert store.latest(spark, path) == 0
    with pytest.raises(ValueError):
        store.frequencies(spark, path)
    assert store.add_documents(docs(spark, texts[:15]), path) == 1
    assert store.add_documents(docs(spark, texts[15:16]), path) == 2
    assert store.add_documents(docs(spark, texts[16:]), path) == 3
    assert read(spark, path) == (fit(spark, texts), 40)
    assert read(spark, path, 1) == (fit(spark, texts[:15]), 15)
    # a share as bound is one of the documents at that version
    assert read(spark, path, max_df=0.4) == (fit(spark, texts, 0.4), 40)
    assert store.compact(spark, path) == 3
    assert read(spark, path) == (fit(spark, texts), 40)
    assert read(spark, path, 2) == (fit(spark, texts[:16]), 16)
    assert store.add_documents(docs(spark, texts[:10]), path, remove=True) == 4
    assert read(spark, path) == (fit(spark, texts[10:]), 30)
    assert store.add_documents(docs(spark, []), path) == 5
    assert read(spark, path) == (fit(spark, texts[10:]), 30)


def test_a_failed_write_is_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    store.add_documents(docs(spark, [(1, "alpha beta")]), path)
    docs(spark, [(9, "zeta")]).selectExpr("combined_features AS term", "9L AS df").write.parquet(f"{path}/changes/version=2")
    assert {r["term"] for r in store.frequencies(spark, path)[0].collect()} == {"alpha", "beta", "alpha beta"}
    store.add_documents(docs(spark, [(2, "alpha")]), path)
    assert {r["term"]: r["df"] for r in store.frequencies(spark, path)[0].collect()} == {"alpha": 2, "beta": 1, "alpha beta": 1}


def test_a_merged_vocabulary_scores_like_a_fitted_one(spark, tmp_path):
    path = str(tmp_path / "store")
    old, new = [(1, "pet care"), (2, "tree care")], [(3, "boat hire"), (4, "pet hire")]
    taxonomy = [(i, t, t) for i, t in enumerate(["pet hire", "tree care", "boat"])]
    labels = spark.createDataFrame(taxonomy, "label_id long, label string, cleaned_label string")
    store.add_documents(docs(spark, old), path)
    store.add_documents(labels, path, "label_id", "cleaned_label")
    store.add_documents(docs(spark, new), path)
    vocab, _ = store.vocabulary(spark, path)
    both = docs(spark, old + new)
    score = lambda **o: {(r[0], r[1]): round(r[2], 9) for r in classify.cosine(both, labels, **o).collect()}
    assert score(vocab=vocab) == score()
