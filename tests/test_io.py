import datetime

import pytest
from pyspark.sql import functions as F

from labelloom.operators import tfidf, tuning
from labelloom.operators.ranking import Weights
from labelloom.plans import classify, preprocess, runs, scratch
from labelloom.plans.classify import Settings
from labelloom.plans.scratch import materialize
from labelloom.sources import models, readers, sinks
from labelloom.streaming import scoring


def test_csv_scan(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('description,sector\n"say ""hi"", you",NA\n"two\nlines",x\n,null\n')
    rows = [tuple(r) for r in readers.load_data(spark, str(path)).collect()]
    assert rows == [('say "hi", you', None), ("two\nlines", "x"), (None, None)]
    with pytest.raises(ValueError):
        readers.load_data(spark, str(tmp_path / "c.xls"))


def test_json_scan(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('[{"a": "x"},\n {"a": null}]')
    assert [r["a"] for r in readers.load_data(spark, str(path)).collect()] == ["x", None]


def test_two_tables(spark, tmp_path):
    (tmp_path / "c.csv").write_text("description\nsame\nsame\n")
    (tmp_path / "t.csv").write_text("label\nB label\nA label\n")
    c, t = readers.load_two_tables(spark, str(tmp_path / "c.csv"), str(tmp_path / "t.csv"))
    assert c.select("company_id").distinct().count() == 2
    assert [tuple(r) for r in t.select("label_id", "label").collect()] == [(0, "B label"), (1, "A label")]


def test_process_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("description,sector\nGL policies,Retail\n")
    (tmp_path / "t.csv").write_text("label\nTree Services\n")
    out = str(tmp_path / "out")
    preprocess.process_files(spark, str(tmp_path / "c.csv"), str(tmp_path / "t.csv"), out + "/c", out + "/t")
    again = readers.load_processed(spark, out + "/c").first()
    assert again["cleaned_description"] == "general liability"
    assert again["description_bigrams"] == ["general liability"]
    c, t = preprocess.process_files(spark, "gone.csv", "gone.csv", out + "/c", out + "/t", reuse=True)
    assert c.first()["company_id"] == again["company_id"] and t.count() == 1
    assert readers.load_processed(spark, out + "/t").first()["label_keywords"] == ["tree", "services"]


def test_export(spark, tmp_path):
    df = spark.createDataFrame(
        [("d, \"x\"", "a, b", "s", [1.0, 0.25])],
        "description string, insurance_label string, sector string, insurance_label_scores array<double>",
    )
    path = str(tmp_path / "e.csv")
    sinks.export_labels(df, path, include_scores=True)
    assert tuple(readers.read_csv(spark, path).first()) == ('d, "x"', "a, b", "s", "1.0000, 0.2500")
    with pytest.raises(ValueError):
        sinks.export_table(df, "missing")


@pytest.fixture
def data(spark):
    companies = spark.createDataFrame(
        [(1, "pet dog office"), (2, "tree pruning"), (3, "data breach")],
        "company_id long, combined_features string",
    )
    labels = spark.createDataFrame(
        [(0, "Pet Care", "pet care"), (1, "Tree Pruning", "tree pruning")],
        "label_id long, label string, cleaned_label string",
    )
    return companies, labels


def test_results_round_trip(spark, tmp_path, data):
    companies, labels = data
    companies = companies.withColumn("description", F.col("combined_features"))
    path, export, model = (str(tmp_path / n) for n in ("full", "export.csv", "model"))
    out = runs.run_classification(companies, labels, output_path=path, export_path=export, model_path=model)
    assert {r["company_id"]: r["insurance_label"] for r in out.collect()}[2] == "Tree Pruning"
    assert readers.load_results(spark, path).count() == 3
    assert readers.read_csv(spark, export).count() == 3
    assert models.load_settings(spark, model).weights == Settings().weights.normalized()
    with pytest.raises(Exception):
        readers.load_results(spark, str(tmp_path / "missing"))


def test_best_trial_reaches_a_run(spark, tmp_path, data):
    companies, labels = data
    trials = tuning.search_space(spark, 4)
    history = tuning.search(companies, labels, trials)
    path = str(tmp_path / "history")
    models.save_history(history, path)
    rows = spark.read.parquet(path).orderBy("position").collect()
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    best = models.best_settings(spark, path)
    assert best.top_k == rows[0]["top_k"] and best.weights.tfidf == rows[0]["tfidf_weight"]


def test_stream_scores_like_a_batch(spark, tmp_path, data):
    companies, labels = data
    counts = tfidf.term_counts(companies, "company_id", "combined_features")
    vocab = materialize(tfidf.vocabulary(tfidf.document_frequency(counts), 5), "v")
    models.save_vocabulary(vocab, str(tmp_path / "m"))
    vocab = models.load_vocabulary(spark, str(tmp_path / "m"))
    companies.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(companies.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scoring.score_stream(stream, labels, vocab, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = scoring.score_with_model(companies, labels, vocab)
    key = lambda df: sorted((r["company_id"], r["insurance_label"]) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 3
    assert dict(key(got))[2] == "Tree Pruning"


def test_stream_scores_a_company_once(spark, tmp_path, data):
    companies, labels = data
    counts = tfidf.term_counts(companies, "company_id", "combined_features")
    vocab = materialize(tfidf.vocabulary(tfidf.document_frequency(counts), 5), "v")
    text = {r["company_id"]: r["combined_features"] for r in companies.collect()}
    schema = "company_id long, combined_features string, seen timestamp"

    def arrive(*rows):
        at = [(i, text[i], datetime.datetime(2024, 1, 1, hour, minute)) for i, hour, minute in rows]
        spark.createDataFrame(at, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = scoring.score_stream(
            stream, labels, vocab, str(tmp_path / "out"), str(tmp_path / "cp"), event_time="seen", delay="1 hour"
        )
        query.awaitTermination()
        return sorted(r["company_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    one, two, three = sorted(text)
    arrive((one, 10, 0), (one, 10, 0), (two, 10, 30))
    arrive((two, 10, 30))  # sent again in the next batch
    assert run() == [one, two]
    arrive((two, 10, 30), (three, 12, 0))  # sent again after a restart
    assert run() == [one, two, three]
    arrive((one, 10, 0))  # older than the watermark
    assert run() == [one, two, three]


def test_settings_come_back_whole(spark, tmp_path):
    odd = Settings(
        top_k=2, threshold=0.1, weights=Weights(2.0, 1.0, 0.5), mode="basic", ensure_one_tag=False,
        require_positive_best=True, bonus_on="cleaned_label", min_df=2, max_df=0.5,
        sector_lexicon={"b": ["x y", "a"], "a": ["z"]},
    )
    for i, settings in enumerate((odd, Settings())):
        models.save_settings(spark, settings, str(tmp_path / str(i)))
        loaded = models.load_settings(spark, str(tmp_path / str(i)))
        assert loaded == settings and type(loaded.min_df) is type(settings.min_df)


def test_label_ids_follow_files_and_lines(spark, tmp_path):
    folder = tmp_path / "taxonomy.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("label\nfirst\nsecond\n")
    (folder / "b.csv").write_text("label\n" + "".join(f"label number {i}\n" for i in range(500)))
    labels = readers.with_label_id(readers.load_data(spark, str(folder)))
    got = [(r["label_id"], r["label"]) for r in labels.collect()]
    assert got == list(enumerate(["first", "second", *[f"label number {i}" for i in range(500)]]))


@pytest.mark.parametrize("size", [1, 1000, 100_000])
def test_width_follows_the_input(size):
    gigabytes = size * 10**9
    width = scratch.width_for(gigabytes, 8)
    assert 8 <= width and gigabytes / width <= scratch.TARGET_BYTES
    assert scratch.width_for(1000, 8) == 8


def test_scopes_of_two_threads(spark):
    from threading import Event, Thread

    made, ended, seen = Event(), Event(), []

    def outer():
        with scratch.scope(spark):
            mine = scratch.materialize_bucketed(spark.range(10), "mine", "id", 2)
            made.set()
            ended.wait(120)
            seen.append(mine.count())

    thread = Thread(target=outer)
    thread.start()
    made.wait(120)
    with scratch.scope(spark):
        scratch.materialize(spark.range(3), "other")
    ended.set()
    thread.join(120)
    assert seen == [10]


def test_a_stored_run_leaves_no_table(spark, tmp_path):
    companies = spark.createDataFrame(
        [(i, f"tree service pruning {i % 3}", "Services") for i in range(20)],
        "company_id long, combined_features string, sector string",
    )
    labels = spark.createDataFrame(
        [(0, "Tree Services", "tree service"), (1, "Pet Services", "pet service")],
        "label_id long, label string, cleaned_label string",
    )
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {scratch.DATABASE}")
    before = spark.sql(f"SHOW TABLES IN {scratch.DATABASE}").count()
    path = str(tmp_path / "out")
    out = runs.run_classification(companies, labels, output_path=path, model_path=str(tmp_path / "model"))
    assert spark.sql(f"SHOW TABLES IN {scratch.DATABASE}").count() == before
    assert out.count() == 20
    model = models.load_model(spark, str(tmp_path / "model"))
    assert model.n_docs == 22 and model.settings == Settings()
