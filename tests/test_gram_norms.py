"""Vector lengths from n-grams dealt by hash, against the plain postings."""

import pytest
from pyspark.sql import functions as F

from labelloom.operators import gram_norms, similarity, tfidf

DOCS = [(1, "aa bb aa cc"), (1, "aa bb"), (2, "cc cc dd"), (None, "aa ee"), (3, None), (4, "x"), (5, "dd aa bb été"), (6, "zz")]


def expected(spark, docs, labels, vocab=None):
    counts = tfidf.term_counts(docs, "k", "text")
    if vocab is None:
        vocab = tfidf.vocabulary(tfidf.document_frequency(counts, labels), 9, 1, 0.4)
    raw = counts.join(tfidf.kept_terms(vocab).select("term", "idf"), "term")
    return tfidf.norms(raw.select("k", (tfidf.sublinear(F.col("tf")) * F.col("idf")).alias("weight")), "k")


@pytest.mark.parametrize("room", [1 << 21, 4])
@pytest.mark.parametrize("given", [False, True])
def test_norms_are_those_of_all_postings(spark, monkeypatch, room, given):
    # with little room there are several parts, and frequent terms are in several of them
    monkeypatch.setattr(gram_norms, "PART_GRAMS", room)
    monkeypatch.setattr(gram_norms, "CHUNK_GRAMS", room)
    docs = spark.createDataFrame(DOCS, "k long, text string").repartition(3)
    labels = spark.createDataFrame([(1, "aa bb"), (2, "dd")], "l long, text string")
    label_counts = tfidf.term_counts(labels, "l", "text")
    vocab = spark.createDataFrame([("aa", 1.5), ("aa bb", 2.0), ("aa bb aa", 3.0), ("cc", None), ("zz", 1.0)], "term string, idf double") if given else None
    texts = gram_norms.key_texts(docs, "k", "text")
    got = gram_norms.norms(texts, "k", 9, label_counts, (1, 0.4 * 9), vocab)
    # a null key has no row in any join by key
    show = lambda df: sorted((r["k"], round(r["norm"], 9)) for r in df.collect() if r["k"] is not None)
    assert show(got) == show(expected(spark, docs, label_counts, vocab))


def test_only_terms_of_labels_become_rows(spark):
    docs = spark.createDataFrame(DOCS, "k long, text string")
    terms = spark.createDataFrame([("aa",), ("aa bb",), ("été",), ("nowhere",)], "term string")
    texts = gram_norms.key_texts(docs, "k", "text")
    every = {(r["k"], r["term"], r["tf"]) for r in tfidf.term_counts(docs, "k", "text").collect()}
    got = [tuple(r) for r in gram_norms.shared_counts(texts, "k", terms).collect()]
    wanted = {t for t in every if t[1] in ("aa", "aa bb", "été")}
    assert len(got) == len(set(got)) and wanted <= set(got) <= every
    assert len(got) < len(every)
    rows = similarity.shared_features(texts, "k", terms)
    assert rows.where(F.col("kind") == similarity.SELF).count() == len(DOCS)
