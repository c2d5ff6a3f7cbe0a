"""One query per operator, over the driver tables.

Lists are shown as text and doubles rounded, so that results can be compared
with another engine's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions import arrays as A
from labelloom.functions import text as T
from labelloom.operators import evaluation, evaluation_state, features, guided, lemmas, lexicon, ranking, similarity, tfidf, tuning
from labelloom.operators.ranking import Weights
from labelloom.plans import classify, preprocess, runs
from labelloom.plans.classify import Settings
from labelloom.plans.scratch import materialize, scratch_path, widen
from labelloom.sources import lexicon_files, models, readers, sinks, split_csv, vocabulary_store
from labelloom.streaming import scoring
from labelloom.workload import inputs

QUERIES = {}
PART_SETTINGS = Settings(sector_lexicon=inputs.PART_SECTORS)
PART_SETTINGS_BASIC = Settings(sector_lexicon=inputs.PART_SECTORS, mode="basic")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def text_of(name: str, sep: str = "|") -> Column:
    column = F.col(name)
    return F.array_join(F.transform(column, lambda x: x.cast("string")), sep).alias(name)


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name).cast("double"), digits).alias(name)


def scores_text(name: str) -> Column:
    return F.array_join(
        F.transform(F.col(name), lambda x: F.round(x * 1_000_000, 0).cast("bigint").cast("string")), "|"
    ).alias(name)


def show(df: DataFrame, key: str = "company_id", extra: list[Column] = ()) -> DataFrame:
    return df.select(
        key, text_of("insurance_labels"), scores_text("insurance_label_scores"), "insurance_label", *extra
    )


# --- text ------------------------------------------------------------------

@query
def txt_clean_names(spark, sf):
    c = inputs.table(spark, sf, "customer")
    suffix = F.get(F.array(*map(F.lit, inputs.SUFFIX_NAMES)), (F.col("c_custkey") % 17).cast("int"))
    named = c.select("c_custkey", F.concat(F.lit(" "), "c_name", suffix, F.lit("  ")).alias("name"))
    return features.clean_names(named, "name")


@query
def txt_title_case(spark, sf):
    return inputs.tailed(spark, sf).select("company_id", T.title_case(F.col("description")).alias("title"))


@query
def txt_abbrev(spark, sf):
    return inputs.tailed(spark, sf).select("company_id", T.normalize_terms(F.col("description")).alias("text"))


@query
def txt_clean_text(spark, sf):
    return inputs.tailed(spark, sf).select("company_id", T.clean_text(F.col("description")).alias("text"))


@query
def txt_phrases(spark, sf):
    d = inputs.tailed(spark, sf)
    return d.select("company_id", T.clean_text(F.col("description"), phrases="observed").alias("text"))


@query
def txt_strip_urls(spark, sf):
    return inputs.tailed(spark, sf).select("company_id", T.strip_urls(F.col("description")).alias("text"))


@query
def txt_char_filter(spark, sf):
    return inputs.tailed(spark, sf).select("company_id", T.letters_only(F.col("description")).alias("text"))


@query
def txt_tokens(spark, sf):
    d = inputs.tailed(spark, sf).select("company_id", A.words(F.col("description")).alias("tokens"))
    return d.select("company_id", F.size("tokens").alias("n"), text_of("tokens"))


@query
def txt_stopwords(spark, sf):
    d = inputs.tailed(spark, sf)
    kept = T.drop_stop_words(A.words(F.lower(T.letters_only(F.col("description")))))
    return d.select("company_id", F.array_join(kept, " ").alias("text"))


@query
def txt_lemmatize(spark, sf):
    d = inputs.cleaned_documents(spark, sf)
    return features.lemmatize(d, "company_id", ["combined_features"], inputs.lemmas(spark))


@query
def txt_lemmatize_rules(spark, sf):
    d = inputs.cleaned_documents(spark, sf)
    return lemmas.lemmatize_by_rules(d, "company_id", ["combined_features"], inputs.lemma_rules(spark, sf))


@query
def txt_ngrams(spark, sf):
    d = inputs.tailed(spark, sf).select("company_id", A.words(T.clean_text(F.col("description"))).alias("w"))
    return d.select(
        "company_id",
        F.array_join(A.ngrams(F.col("w"), 2), "|").alias("bigrams"),
        F.array_join(A.ngrams(F.col("w"), 3), "|").alias("trigrams"),
    )


@query
def txt_label_keywords(spark, sf):
    out = features.label_keywords(inputs.part_labels(spark, sf))
    return out.select("label_id", "label", text_of("label_keywords"), text_of("label_bigrams"))


def _expandable(spark, sf):
    kinds = ["Real Estate", "construction and Retail", "Technology", "x", "Financial Consulting"]
    pick = F.get(F.array(*map(F.lit, kinds)), (F.col("label_id") % 5).cast("int"))
    return inputs.part_labels(spark, sf).select(
        "label_id", F.concat_ws(" ", pick, "label").alias("label"),
        F.when(F.col("label_id") % 3 > 0, F.col("cleaned_label")).alias("description"),
    )


@query
def txt_expand_label(spark, sf):
    return features.expand_labels(_expandable(spark, sf)).select("label_id", "label", "expanded_terms")


@query
def txt_expand_taxonomy(spark, sf):
    return features.expand_labels(_expandable(spark, sf)).select(
        "label_id", "expanded_description", "cleaned_expanded"
    )


@query
def txt_key_terms_opt(spark, sf):
    out = features.with_key_terms(inputs.cleaned_documents(spark, sf), "combined_features")
    return out.select("company_id", text_of("key_terms"))


@query
def txt_key_terms_basic(spark, sf):
    out = features.with_key_terms(inputs.cleaned_documents(spark, sf), "combined_features", "basic")
    return out.select("company_id", text_of("key_terms"))


# --- features --------------------------------------------------------------

@query
def feat_combined(spark, sf):
    out = preprocess.preprocess_companies(inputs.parts(spark, sf))
    return out.select("company_id", "combined_features")


@query
def feat_keywords(spark, sf):
    d = inputs.tailed(spark, sf).select("company_id", "description")
    out = features.industry_keywords(d, "description")
    flags = [c for c in out.columns if c.startswith("is_")]
    return out.select("company_id", text_of("detected_industries"), *flags)


@query
def feat_size_category(spark, sf):
    users = inputs.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("employees"))
    orders = inputs.table(spark, sf, "part").select(
        (-F.col("p_partkey") - 1).alias("user_id"),
        (F.nullif(F.col("p_size"), F.lit(7)) * F.col("p_size") / 2 - 1).alias("employees"),
    )
    both = users.withColumn("employees", F.col("employees").cast("double")).unionByName(orders)
    return features.size_category(both).select("user_id", "size_category")


@query
def feat_location(spark, sf):
    c = inputs.customers(spark, sf)
    k = F.col("c_custkey") % 5
    place = (
        F.when(k == 0, F.col("c_name"))
        .when(k == 1, F.concat_ws(", ", "c_name", "n_name"))
        .when(k == 2, F.concat_ws(",  ", "c_name", "n_name", "r_name"))
        .when(k == 3, F.concat_ws(",", "c_name", "n_name", "r_name", "c_mktsegment"))
    )
    out = features.normalize_location(c.select("c_custkey", place.alias("place")), "place")
    return out.select("c_custkey", "city", "state", "country")


@query
def feat_label_features(spark, sf):
    out = similarity.label_features(
        inputs.part_labels(spark, sf), "optimized", inputs.PART_SECTORS, inputs.synonyms(spark)
    )
    return out.select("label_id", text_of("key_terms"), text_of("synonyms"), text_of("insurance_sectors"))


@query
def pipe_companies(spark, sf):
    out = preprocess.preprocess_companies(inputs.tailed(spark, sf), combined=False)
    return out.select(
        "company_id", "cleaned_description", "cleaned_sector", "cleaned_category",
        text_of("description_bigrams"), text_of("description_trigrams"), text_of("detected_industries"),
        "is_insurance", "is_casualty", "is_health",
    )


@query
def pipe_taxonomy(spark, sf):
    labels = inputs.benchmark(spark, sf).select("label_id", "label")
    out = preprocess.preprocess_taxonomy(labels)
    return out.select("label_id", "cleaned_label", text_of("label_keywords"), text_of("label_bigrams"))


@query
def pipe_generic(spark, sf):
    c = inputs.customers(spark, sf).select(
        F.col("c_custkey").alias("company_id"),
        F.concat("c_name", F.lit(" Ltd.")).alias("name"),
        F.lower("c_mktsegment").alias("description"),
        F.floor(F.abs("c_acctbal") / 10).alias("employees"),
        F.concat_ws(", ", "n_name", "r_name").alias("location"),
    )
    out = preprocess.process_table(
        c, "name", "description", "employees", "location", enhanced=False
    )
    return out.select(
        "company_id", "name", "size_category", "city", "country", "is_automotive",
        text_of("detected_industries"),
    )


@query
def pipe_both(spark, sf):
    """Both tables from their files, processed, written, and loaded again."""
    company_path, label_path = (scratch_path(spark, n) + ".csv" for n in ("companies", "taxonomy"))
    sinks.write_table(inputs.parts(spark, sf), company_path, "csv")
    sinks.write_table(inputs.part_labels(spark, sf).select("label").orderBy("label").coalesce(1), label_path, "csv")
    outputs = [scratch_path(spark, n) for n in ("processed_companies", "processed_taxonomy")]
    preprocess.process_files(spark, company_path, label_path, *outputs)
    companies, taxonomy = preprocess.process_files(spark, "nowhere.csv", "nowhere.csv", *outputs, reuse=True)
    left = companies.select(
        F.lit("company").alias("side"), F.col("company_id").cast("bigint").alias("id"),
        F.col("cleaned_description").alias("cleaned"), text_of("description_bigrams").alias("bigrams"),
    )
    right = taxonomy.select(
        F.lit("label").alias("side"), F.col("label_id").cast("bigint").alias("id"),
        F.col("cleaned_label").alias("cleaned"), text_of("label_bigrams").alias("bigrams"),
    )
    return left.unionByName(right)


# --- lexicons --------------------------------------------------------------

def _terms(spark, sf, mode):
    return features.with_key_terms(inputs.part_texts(spark, sf), "combined_features", mode)


@query
def lex_synonyms_bounded(spark, sf):
    out = lexicon.expand_synonyms(
        _terms(spark, sf, "optimized"), "company_id", "key_terms", inputs.synonyms(spark)
    )
    return out.select("company_id", text_of("synonyms"))


@query
def lex_synonyms_full(spark, sf):
    out = lexicon.expand_synonyms_full(
        _terms(spark, sf, "basic"), "company_id", "key_terms", inputs.synonyms(spark)
    )
    return out.select("company_id", text_of("synonyms"))


@query
def lex_sectors_word(spark, sf):
    d = inputs.tailed(spark, sf)
    out = lexicon.with_sectors(d, "description", "insurance_sectors")
    return out.select("company_id", text_of("insurance_sectors"))


@query
def lex_sectors_substring(spark, sf):
    d = inputs.tailed(spark, sf)
    out = lexicon.with_sectors(d, "description", "insurance_sectors", "basic")
    return out.select("company_id", text_of("insurance_sectors"))


# --- TF-IDF ----------------------------------------------------------------

def _turn_counts(spark, sf):
    labels = inputs.benchmark(spark, sf)
    both = tfidf.corpus(inputs.turns(spark, sf), labels)
    keyed = both.select(F.concat_ws(":", "side", "id").alias("doc"), "text")
    return keyed, materialize(tfidf.term_counts(keyed, "doc", "text"), "counts")


def _turn_vocabulary(spark, sf):
    docs, counts = _turn_counts(spark, sf)
    n_docs = docs.count()
    vocab = tfidf.vocabulary(tfidf.document_frequency(counts), n_docs)
    return counts, materialize(vocab, "vocabulary")


@query
def tfidf_fit(spark, sf):
    """The vocabulary fitted on documents and labels together."""
    both = tfidf.corpus(inputs.cleaned_documents(spark, sf), inputs.benchmark(spark, sf))
    keyed = materialize(both.select(F.concat_ws(":", "side", "id").alias("doc"), "text"), "corpus")
    counts = tfidf.term_counts(keyed, "doc", "text")
    n_docs = keyed.count()
    vocab = tfidf.kept_terms(tfidf.vocabulary(tfidf.document_frequency(counts), n_docs))
    return vocab.select("term", "df", rounded("idf"), F.lit(n_docs).cast("bigint").alias("n_docs"))


@query
def tfidf_terms(spark, sf):
    return _turn_counts(spark, sf)[1].select("doc", "term", "tf")


@query
def tfidf_df_prune(spark, sf):
    _, vocab = _turn_vocabulary(spark, sf)
    return tfidf.kept_terms(vocab).select("term", "df")


@query
def tfidf_idf(spark, sf):
    _, vocab = _turn_vocabulary(spark, sf)
    return tfidf.kept_terms(vocab).select("term", rounded("idf"))


@query
def tfidf_weights(spark, sf):
    counts, vocab = _turn_vocabulary(spark, sf)
    weighed = tfidf.weigh(counts, vocab)
    return weighed.select(
        "doc", "term", F.round(tfidf.sublinear(F.col("tf")) * F.col("idf"), 6).alias("weight")
    )


@query
def tfidf_norm(spark, sf):
    counts, vocab = _turn_vocabulary(spark, sf)
    return tfidf.unit_vectors(counts, "doc", vocab).select("doc", "term", rounded("weight"))


@query
def tfidf_transform(spark, sf):
    _, vocab = _turn_vocabulary(spark, sf)
    out = tfidf.transform(inputs.part_texts(spark, sf), "company_id", "combined_features", vocab)
    docs = tfidf.transform(inputs.cleaned_documents(spark, sf), "company_id", "combined_features", vocab)
    both = out.withColumn("side", F.lit("part")).unionByName(docs.withColumn("side", F.lit("document")))
    return both.select("side", "company_id", "term", rounded("weight"))


@query
def tfidf_vocab_size(spark, sf):
    docs = inputs.cleaned_documents(spark, sf)
    counts = tfidf.term_counts(docs, "company_id", "combined_features")
    vocab = tfidf.vocabulary(tfidf.document_frequency(counts), docs.count())
    return tfidf.kept_terms(vocab).agg(F.count(F.lit(1)).alias("vocabulary_size"))


# --- similarities ----------------------------------------------------------

@query
def sim_cosine(spark, sf):
    out = classify.cosine(inputs.cleaned_documents(spark, sf), inputs.benchmark(spark, sf))
    return out.select("company_id", "label_id", rounded("score"))


def _components(spark, sf, settings=PART_SETTINGS):
    return classify.ensemble_pairs(
        inputs.part_texts(spark, sf), inputs.part_labels(spark, sf), settings,
        synonyms=inputs.synonyms(spark),
    )


def _component(spark, sf, name, settings=PART_SETTINGS):
    _, pairs = _components(spark, sf, settings)
    return pairs.where(F.col(name) > 0).select("company_id", "label_id", rounded(name))


@query
def sim_sector_jaccard(spark, sf):
    return _component(spark, sf, "keyword")


@query
def sim_synonym_jaccard(spark, sf):
    return _component(spark, sf, "wordnet")


@query
def sim_exact_bonus(spark, sf):
    return _component(spark, sf, "bonus")


def _sectored(spark, sf):
    return inputs.table(spark, sf, "part", "p_partkey").select(
        F.col("p_partkey").alias("company_id"), F.col("p_type").alias("sector"),
        F.nullif(F.col("p_brand"), F.lit("Brand#7")).alias("category"),
        F.when(F.col("p_size") > 9, F.col("p_name")).alias("niche"),
    )


@query
def sim_sector_fallback(spark, sf):
    out = similarity.sector_fallback(
        _sectored(spark, sf), inputs.part_labels(spark, sf), lexicon=inputs.PART_SECTORS
    )
    return out.select("company_id", "label", rounded("score"))


@query
def score_weights(spark, sf):
    lines = inputs.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_discount").alias("t"), F.col("l_tax").alias("w"), (F.col("l_quantity") / 100).alias("k"),
    )
    zero = lines.withColumn("k", F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("k")))
    out = ranking.normalized_weights(zero, "t", "w", "k")
    return out.select(
        "l_orderkey", "l_linenumber", rounded("tfidf_weight"), rounded("wordnet_weight"), rounded("keyword_weight")
    )


@query
def score_ensemble(spark, sf):
    _, pairs = _components(spark, sf)
    out = ranking.ensemble_score(pairs, PART_SETTINGS.weights).where(F.col("raw_score") > 0)
    return out.select("company_id", "label_id", rounded("raw_score"))


@query
def score_rescale(spark, sf):
    _, pairs = _components(spark, sf)
    scored = ranking.ensemble_score(pairs, PART_SETTINGS.weights).where(F.col("raw_score") > 0)
    return ranking.rescale(scored, ["company_id"]).select("company_id", "label_id", rounded("score"))


# --- ranking and classifiers -----------------------------------------------

@query
def rank_topk_tfidf(spark, sf):
    _, matches = classify.top_matches(
        inputs.cleaned_documents(spark, sf), inputs.benchmark(spark, sf), top_k=5, threshold=0.02
    )
    return matches.select("company_id", "label_id", rounded("score"), "rank")


@query
def rank_topk_ensemble(spark, sf):
    _, pairs = _components(spark, sf)
    scored = ranking.ensemble_score(pairs, PART_SETTINGS.weights)
    top = ranking.rescale(ranking.top_k_pairs(scored, ["company_id"], "raw_score", 5), ["company_id"])
    return top.where(ranking.at_least("score", 0.08)).select("company_id", "label_id", rounded("score"), "rank")


@query
def rank_ensure_one(spark, sf):
    out = classify.ensemble_classify(
        inputs.turns(spark, sf), inputs.part_labels(spark, sf), PART_SETTINGS
    )
    return show(out)


@query
def rank_fallback_chain(spark, sf):
    companies = _sectored(spark, sf).withColumn(
        "combined_features", F.when(F.col("company_id") % 3 == 0, F.lit("")).otherwise(F.lower("sector"))
    )
    labels = inputs.part_labels(spark, sf).withColumn(
        "cleaned_label", F.when(F.col("label_id") % 2 == 0, F.col("cleaned_label")).otherwise("")
    )
    settings = Settings(sector_lexicon=inputs.PART_SECTORS, require_positive_best=True)
    return show(classify.ensemble_classify(companies, labels, settings))


@query
def pipe_tfidf_classify(spark, sf):
    out = classify.tfidf_classify(
        inputs.cleaned_documents(spark, sf), inputs.benchmark(spark, sf), top_k=3, threshold=0.05
    )
    return show(out)


@query
def agg_labels_list(spark, sf):
    matches = inputs.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("rank"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("label"), F.col("l_discount").alias("score"),
    )
    # a key of order and line number is not unique, so the lists are sorted by all fields
    lists = ranking.label_lists(matches, ["l_orderkey"])
    return show(ranking.with_label_text(lists), "l_orderkey")


def _part_ensemble(spark, sf, settings):
    companies = preprocess.preprocess_companies(inputs.parts(spark, sf), combined=False)
    return classify.ensemble_classify(
        companies, inputs.part_labels(spark, sf), settings,
        synonyms=inputs.synonyms(spark), repeats=features.repeat_plan(companies),
    )


@query
def pipe_ensemble_opt(spark, sf):
    out = _part_ensemble(spark, sf, PART_SETTINGS)
    return show(out, extra=[scores_text(ranking.RAW_SCORES)])


@query
def pipe_ensemble_basic(spark, sf):
    return show(_part_ensemble(spark, sf, PART_SETTINGS_BASIC))


@query
def pipe_run(spark, sf):
    out = runs.run_classification(
        preprocess.preprocess_companies(inputs.parts(spark, sf)),
        inputs.part_labels(spark, sf), PART_SETTINGS,
        output_path=scratch_path(spark, "run"), export_path=scratch_path(spark, "export"),
        model_path=scratch_path(spark, "model"), synonyms=inputs.synonyms(spark),
    )
    return show(out)


@query
def pipe_score_saved(spark, sf):
    _, vocab = _turn_vocabulary(spark, sf)
    path = scratch_path(spark, "model")
    models.save_vocabulary(tfidf.kept_terms(vocab), path)
    out = scoring.score_with_model(
        inputs.cleaned_documents(spark, sf), inputs.benchmark(spark, sf),
        models.load_vocabulary(spark, path), top_k=3, threshold=0.05,
    )
    return show(out)


@query
def pipe_score_stream(spark, sf):
    """Events scored as a stream of three files: the earlier half, the later half
    with some of the earlier sent again, and every fifth event once more."""
    events, labels = materialize(inputs.event_texts(spark, sf), "events"), inputs.event_labels(spark, sf)
    counts = [
        tfidf.term_counts(d.select(F.col(k).cast("string").alias("doc"), F.col(t).alias("text")), "doc", "text")
        for d, k, t in ((events, "company_id", "combined_features"), (labels, "label_id", "cleaned_label"))
    ]
    vocab = tfidf.vocabulary(tfidf.document_frequency(*counts), events.count() + labels.count())
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(first + (last - first) / 2)
    source = scratch_path(spark, "stream")
    again = (F.col("ts") < middle) & (F.col("ts") > middle - F.expr("INTERVAL 1 DAY"))
    for rows in (
        events.where(F.col("ts") < middle),
        events.where(F.col("ts") >= middle).unionAll(events.where(again)),
        events.where("company_id % 5 = 0"),
    ):
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = scratch_path(spark, "scored")
    scoring.score_stream(
        stream, labels, materialize(vocab, "vocabulary"), path, scratch_path(spark, "checkpoint"),
        event_time="ts", delay="2 days", top_k=3, threshold=0.05,
    ).awaitTermination()
    return show(spark.read.parquet(path))


@query
def pipe_score_loaded(spark, sf):
    """Run and save the model, then load it and score the same table afresh."""
    path = scratch_path(spark, "model")
    companies = preprocess.preprocess_companies(inputs.parts(spark, sf))
    labels = inputs.part_labels(spark, sf)
    runs.run_classification(
        companies, labels, PART_SETTINGS, output_path=scratch_path(spark, "run"), model_path=path,
        synonyms=inputs.synonyms(spark),
    )
    model = models.load_model(spark, path)
    out = scoring.score_with_model(
        companies, labels, model.vocab, model.settings, synonyms=inputs.synonyms(spark)
    )
    return show(out)


# --- evaluation ------------------------------------------------------------

@query
def eval_summary(spark, sf):
    out = evaluation.summary(inputs.classified(spark, sf))
    return out.withColumns({
        c: F.round(c, 6) for c in ("coverage_percentage", "avg_labels_per_company")
    })


@query
def eval_label_histogram(spark, sf):
    return evaluation.label_histogram(inputs.classified(spark, sf))


@query
def eval_top_labels(spark, sf):
    return evaluation.top_labels(inputs.classified(spark, sf))


@query
def eval_bottom_labels(spark, sf):
    return evaluation.bottom_labels(inputs.classified(spark, sf))


@query
def eval_companies_per_label(spark, sf):
    return evaluation.label_counts(inputs.classified(spark, sf))


@query
def eval_assignment_stats(spark, sf):
    out = evaluation.assignment_stats(inputs.classified(spark, sf))
    return out.withColumn("avg_labels_per_company", F.round("avg_labels_per_company", 6))


@query
def eval_score_stats(spark, sf):
    out = evaluation.score_stats(inputs.classified(spark, sf))
    return out.select(*[rounded(c) for c in out.columns])


@query
def eval_score_histogram(spark, sf):
    return evaluation.score_histogram(inputs.classified(spark, sf))


@query
def eval_coverage(spark, sf):
    out = evaluation.coverage(inputs.classified(spark, sf))
    return out.withColumn("coverage_percentage", F.round("coverage_percentage", 6))


@query
def eval_report(spark, sf):
    out = evaluation.evaluation_report(inputs.classified(spark, sf))
    return out.withColumn("value", F.round("value", 6))


@query
def eval_report_merged(spark, sf):
    """The report over four runs from their states, one of them run twice."""
    classified = materialize(inputs.classified(spark, sf), "classified")
    path = scratch_path(spark, "states")
    evaluation_state.save_state(classified.where("company_id % 2 = 0"), path, "r0")
    for i in range(4):
        evaluation_state.save_state(classified.where(F.col("company_id") % 4 == i), path, f"r{i}")
    out = evaluation_state.report(evaluation_state.load_state(spark, path))
    return out.withColumn("value", F.round("value", 6))


@query
def eval_chart_data(spark, sf):
    return evaluation.chart_data(inputs.classified(spark, sf))


@query
def rel_filter_threshold(spark, sf):
    exploded = inputs.classified(spark, sf).select(
        "company_id",
        F.inline(F.arrays_zip(F.col("insurance_labels").alias("label"), F.col("insurance_label_scores").alias("score"))),
    ).toDF("company_id", "label", "score")
    return exploded.where(ranking.at_least("score", 0.3)).select("company_id", "label", rounded("score"))


# --- parameter search ------------------------------------------------------

@query
def tune_sample(spark, sf):
    return tuning.sample(inputs.documents(spark, sf)).select("company_id")


@query
def tune_objective(spark, sf):
    per_nation = inputs.classified(spark, sf, ["c_nationkey"]).withColumnRenamed("c_nationkey", "trial_id")
    out = tuning.objective(per_nation, 8)
    return out.select("trial_id", *[rounded(c) for c in ("coverage", "confidence", "diversity", "score")])


def _search(spark, sf, **options):
    return tuning.search(
        inputs.part_texts(spark, sf), inputs.part_labels(spark, sf), inputs.trials(spark),
        settings=PART_SETTINGS, synonyms=inputs.synonyms(spark), **options,
    )


@query
def tune_search(spark, sf):
    out = _search(spark, sf)
    return out.select("trial_id", "position", *[rounded(c) for c in ("coverage", "confidence", "diversity", "score")])


@query
def tune_search_full(spark, sf):
    """The search over all parts."""
    out = _search(spark, sf, n=None)
    return out.select("trial_id", "position", *[rounded(c) for c in ("coverage", "confidence", "diversity", "score")])


@query
def tune_history(spark, sf):
    path = scratch_path(spark, "history")
    models.save_history(_search(spark, sf), path)
    return spark.read.parquet(path).select(
        "trial_id", "top_k", "position", rounded("threshold"), rounded("tfidf_weight"), rounded("score")
    )


@query
def tune_apply_best(spark, sf):
    path = scratch_path(spark, "history")
    models.save_history(_search(spark, sf), path)
    out = runs.run_with_best_trial(
        inputs.part_texts(spark, sf), inputs.part_labels(spark, sf), path, PART_SETTINGS,
        synonyms=inputs.synonyms(spark),
    )
    return show(out)


@query
def tune_density(spark, sf):
    """Densities of good and bad trials over a grid of every parameter."""
    spans = guided.ranges(spark)
    seen = materialize(guided.observations(_search(spark, sf), 0.4), "observations")
    step = (F.col("high") - F.col("low")) / 10
    grid = spans.select("parameter", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("point"), "low", step.alias("step"))
    points = grid.select("parameter", "point", (F.col("low") + F.col("point") * F.col("step")).alias("x"))
    out = guided.densities(points, seen, spans, ["point"])
    return out.select("parameter", "point", *[rounded(c) for c in ("x", "good", "bad")])


@query
def tune_search_guided(spark, sf):
    """A search resumed from a stored history, in two blocks of guided trials."""
    path = scratch_path(spark, "study")
    models.save_history(_search(spark, sf).drop("position"), path)
    out = guided.search(
        inputs.part_texts(spark, sf), inputs.part_labels(spark, sf), path, n_trials=8, block=4, startup=5,
        good_share=0.4, settings=PART_SETTINGS, synonyms=inputs.synonyms(spark),
    )
    return out.select("trial_id", "position", "top_k", *[rounded(c) for c in ("threshold", "tfidf_weight", "score")])


@query
def tune_objective_f1(spark, sf):
    """Priorities of a customer's orders of even months against those of all orders."""
    orders = inputs.table(spark, sf, "orders")
    given = orders.where(F.month("o_orderdate") % 2 == 0).select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("label"))
    per_nation = inputs.classified(spark, sf, ["c_nationkey"]).withColumnRenamed("c_nationkey", "trial_id")
    out = tuning.annotated_objective(per_nation, given)
    return out.select("trial_id", *[rounded(c) for c in out.columns[1:]])


# --- sources, sinks, saved models ------------------------------------------

def _messy(spark, sf):
    """Suppliers with quotes, line breaks and null tokens."""
    k = F.col("s_suppkey") % 4
    return inputs.table(spark, sf, "supplier").select(
        "s_suppkey",
        F.when(k == 0, F.concat(F.lit('say "hi", '), "s_name"))
        .when(k == 1, F.concat("s_name", F.lit("\nsecond line")))
        .when(k == 2, F.lit("N/A")).otherwise(F.col("s_name")).alias("description"),
        F.when(k == 3, F.lit("null")).otherwise(F.concat(F.lit("sector "), k)).alias("sector"),
        "s_acctbal",
    )


_MESSY = "s_suppkey bigint, description string, sector string, s_acctbal double"


@query
def src_scan_csv(spark, sf):
    path = scratch_path(spark, "companies") + ".csv"
    sinks.write_table(_messy(spark, sf), path, "csv")
    return readers.load_data(spark, path, _MESSY)


@query
def src_scan_csv_split(spark, sf):
    """One file, read in splits of 2 KB."""
    path = scratch_path(spark, "companies") + ".csv"
    sinks.write_table(_messy(spark, sf).coalesce(1), path, "csv")
    return split_csv.read_csv_split(spark, path, _MESSY, size=2048)


@query
def src_scan_json(spark, sf):
    path = scratch_path(spark, "companies") + ".json"
    _messy(spark, sf).write.json(path)
    return readers.load_data(spark, path, _MESSY, lines=True)


@query
def src_scan_synsets(spark, sf):
    folder = scratch_path(spark, "lexicon")
    inputs.write_lexicon(spark, sf, folder)
    return lexicon_files.read_synsets(spark, folder)


@query
def src_two_tables(spark, sf):
    company_path = scratch_path(spark, "companies") + ".csv"
    label_path = scratch_path(spark, "taxonomy") + ".csv"
    sinks.write_table(inputs.parts(spark, sf).drop("company_id"), company_path, "csv")
    labels = inputs.part_labels(spark, sf).select("label").orderBy("label").coalesce(1)
    sinks.write_table(labels, label_path, "csv")
    companies, taxonomy = readers.load_two_tables(spark, company_path, label_path)
    per_text = companies.groupBy("description", "category").agg(
        F.count_distinct("company_id").alias("n")
    ).select(F.concat_ws("/", "description", "category").alias("text"), "n")
    return per_text.unionByName(taxonomy.select(F.col("label").alias("text"), F.col("label_id").alias("n")))


@query
def src_reload(spark, sf):
    path = scratch_path(spark, "processed")
    sinks.write_table(preprocess.preprocess_companies(inputs.parts(spark, sf)), path)
    out = readers.load_processed(spark, path)
    return out.select("company_id", "combined_features", text_of("description_bigrams"))


def _python_repr(column: str) -> Column:
    quoted = F.transform(
        column,
        lambda x: F.when(F.contains(x, F.lit("'")), F.concat(F.lit('"'), x, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), x, F.lit("'"))),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


@query
def arr_parse_labels(spark, sf):
    d = inputs.classified(spark, sf)
    odd = F.transform("insurance_labels", lambda x: F.replace(x, F.lit("H"), F.lit("'")))
    cells = d.withColumn("odd", odd).select(
        "company_id",
        F.when(F.col("company_id") % 3 == 0, F.col("insurance_label"))
        .otherwise(_python_repr("odd")).alias("cell"),
    )
    parsed = cells.select("company_id", A.label_list(F.col("cell")).alias("labels"))
    return parsed.select("company_id", F.size("labels").alias("n"), text_of("labels"))


@query
def src_results(spark, sf):
    d = inputs.classified(spark, sf)
    path = scratch_path(spark, "results") + ".csv"
    sinks.write_table(d, path, "csv")
    return show(readers.load_results(spark, path))


@query
def sink_processed(spark, sf):
    out = preprocess.preprocess_taxonomy(inputs.benchmark(spark, sf).select("label_id", "label"))
    path = scratch_path(spark, "taxonomy")
    sinks.write_table(out, path)
    return readers.load_processed(spark, path).select(
        "label_id", "cleaned_label", text_of("label_keywords"), text_of("label_bigrams")
    )


@query
def sink_classified(spark, sf):
    path = scratch_path(spark, "classified")
    sinks.write_table(inputs.classified(spark, sf), path)
    return show(readers.load_results(spark, path))


@query
def sink_export(spark, sf):
    d = inputs.classified(spark, sf, ["c_name", F.col("c_mktsegment").alias("sector")])
    path = scratch_path(spark, "export") + ".csv"
    sinks.export_labels(d, path, description_column="c_name", include_scores=True)
    out = readers.read_csv(spark, path)
    return out.select("description", "insurance_label", "sector", F.coalesce("label_scores", F.lit("")).alias("label_scores"))


@query
def sink_report(spark, sf):
    path = scratch_path(spark, "report") + ".csv"
    sinks.write_report(inputs.classified(spark, sf), path)
    out = readers.read_csv(spark, path, "section string, metric string, value double")
    return out.withColumn("value", F.round("value", 6))


@query
def model_tfidf_roundtrip(spark, sf):
    _, vocab = _turn_vocabulary(spark, sf)
    path = scratch_path(spark, "model")
    models.save_vocabulary(tfidf.kept_terms(vocab), path)
    return models.load_vocabulary(spark, path).select("term", "df", rounded("idf"))


@query
def model_vocabulary_merge(spark, sf):
    """Turns and labels added in three versions, the first two summed up, one
    batch added twice and taken out again."""
    path = scratch_path(spark, "store")
    turns = inputs.turns(spark, sf)
    part = F.pmod(F.xxhash64("company_id"), F.lit(3))
    vocabulary_store.add_documents(inputs.benchmark(spark, sf), path, "label_id", "cleaned_label")
    vocabulary_store.add_documents(turns.where(part == 0), path)
    vocabulary_store.add_documents(turns.where(part == 1), path)
    vocabulary_store.compact(spark, path)
    vocabulary_store.add_documents(turns.where(part != 0), path)
    vocabulary_store.add_documents(turns.where(part == 1), path, remove=True)
    vocab, n_docs = vocabulary_store.vocabulary(spark, path)
    return tfidf.kept_terms(vocab).select("term", "df", rounded("idf"), F.lit(n_docs).cast("bigint").alias("n_docs"))


SAVED_SETTINGS = Settings(
    top_k=4, threshold=0.07, weights=Weights(0.5, 0.3, 0.1), mode="basic", ensure_one_tag=False,
    require_positive_best=True, bonus_on="cleaned_label", min_df=2, max_df=0.8, sector_lexicon=inputs.PART_SECTORS,
)


@query
def model_config_roundtrip(spark, sf):
    """All settings, the number of documents and the sector lexicon of a saved model."""
    path = scratch_path(spark, "model")
    texts = inputs.part_texts(spark, sf)
    counts = tfidf.term_counts(texts, "company_id", "combined_features")
    n_docs = texts.count()
    vocab = tfidf.vocabulary(tfidf.document_frequency(counts), n_docs, 2, 0.8)
    models.save_model(models.Model(vocab, n_docs, SAVED_SETTINGS), path)
    model = models.load_model(spark, path)
    settings, w = model.settings, model.settings.weights
    out = lexicon.with_sectors(texts, "combined_features", "sectors", settings.mode, settings.sectors())
    scalar = ("top_k", "threshold", "mode", "ensure_one_tag", "require_positive_best", "bonus_on", "min_df", "max_df")
    return out.select(
        "company_id", text_of("sectors"), *[F.lit(getattr(settings, c)).alias(c) for c in scalar],
        *[F.lit(getattr(w, c)).alias(f"{c}_weight") for c in ("tfidf", "wordnet", "keyword")],
        F.lit(model.n_docs).cast("bigint").alias("n_docs"), F.lit(tfidf.kept_terms(model.vocab).count()).alias("terms"),
    )
