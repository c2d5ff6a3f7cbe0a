"""N-grams counted inside their row, and vectors under a given vocabulary."""

from labelloom.operators import tfidf


def test_texts_of_one_key_are_counted_together(spark):
    rows = [(1, "aa bb aa"), (1, "aa bb"), (2, "cc cc dd"), (None, "ee"), (None, "ee ff"), (3, None), (4, "x")]
    counts = tfidf.term_counts(spark.createDataFrame(rows, "k long, text string"), "k", "text", (1, 2))
    got = sorted((str(r["k"]), r["term"], r["tf"]) for r in counts.collect())
    assert got == [
        ("1", "aa", 3), ("1", "aa bb", 2), ("1", "bb", 2), ("1", "bb aa", 1),
        ("2", "cc", 2), ("2", "cc cc", 1), ("2", "cc dd", 1), ("2", "dd", 1),
        ("None", "ee", 2), ("None", "ee ff", 1), ("None", "ff", 1),
    ]
    plan = counts.where("k = 2")._jdf.queryExecution().optimizedPlan().toString()
    assert "_same" in plan  # keys of one text are not grouped by term


def test_words_outside_a_large_vocabulary_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "fits_broadcast", lambda df: False)
    vocab = spark.createDataFrame([(f"w{i}", 2, 1.0 + i) for i in range(50)], "term string, df long, idf double")
    docs = spark.createDataFrame([(1, "w1 w2 unknown"), (2, "unknown words"), (3, "w3")], "k long, text string")
    got = {(r["k"], r["term"]): r["weight"] for r in tfidf.transform(docs, "k", "text", vocab).collect()}
    assert set(got) == {(1, "w1"), (1, "w2"), (3, "w3")}
    assert abs(got[1, "w1"] - 2 / 13**0.5) < 1e-9 and got[3, "w3"] == 1


def test_a_transform_writes_only_what_the_vocabulary_may_have(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox " + " ".join(f"unseen{i} other{i}" for i in range(200))), (2, "red hen"), (None, "red fox"), (3, "none here")], "k int, text string")
    vocab = spark.createDataFrame([("red", 2, 1.5), ("fox", 1, 2.0), ("red fox", 1, 3.0), ("hen", 9, None)], "term string, df long, idf double")
    written = []
    monkeypatch.setattr(tfidf, "materialize", lambda df, name: written.append(df.count()) or df)
    got = {(r["k"], r["term"]): r["weight"] for r in tfidf.transform(docs, "k", "text", vocab).collect()}
    assert sum(written) < 150  # of some 1,200 n-grams; a small filter lets some by
    norm = (1.5**2 + 2**2 + 3**2) ** 0.5
    want = {(1, "red"): 1.5 / norm, (1, "fox"): 2 / norm, (1, "red fox"): 3 / norm, (2, "red"): 1.0}
    assert got.keys() == want.keys() and all(abs(got[k] - w) < 1e-12 for k, w in want.items())
