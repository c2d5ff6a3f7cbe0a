"""The classifiers: TF-IDF only, and the ensemble in two modes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from labelloom.functions import lexicons
from labelloom.operators import features as feat
from labelloom.operators import gram_norms, pruning, ranking, similarity, tfidf
from labelloom.operators.ranking import Weights
from labelloom.plans.joins import lookup_join
from labelloom.plans.scratch import materialize


@dataclass(frozen=True)
class Settings:
    """Parameters of a classification run."""

    top_k: int = 3
    threshold: float = 0.05
    weights: Weights = field(default_factory=Weights)
    mode: str = "optimized"
    ensure_one_tag: bool = True
    require_positive_best: bool = False
    bonus_on: str = "label"
    min_df: float = 1
    max_df: float = 0.9
    sector_lexicon: dict[str, list[str]] = None

    def sectors(self) -> dict[str, list[str]]:
        return lexicons.SECTOR_KEYWORDS if self.sector_lexicon is None else self.sector_lexicon


def fit(
    features: DataFrame,
    label_counts: DataFrame,
    n_docs: int,
    min_df: float = 1,
    max_df: float = 0.9,
) -> DataFrame:
    """Vocabulary over company grams and label grams, written once."""
    grams = features.where(F.col("kind") == "gram")
    frequencies = tfidf.document_frequency(grams, label_counts)
    return materialize(tfidf.vocabulary(frequencies, n_docs, min_df, max_df), "vocabulary")


def company_ids(features: DataFrame, key: str) -> DataFrame:
    return features.where(F.col("kind") == similarity.SELF).select(key)


def _named(ranked: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return lookup_join(ranked, labels.select("label_id", "label"), ["label_id"], spread=key)


def _finish(ids: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    lists = ranking.label_lists(matches, [key])
    return ranking.with_label_text(ids.join(lists, key, "left"))


@dataclass(frozen=True)
class PreparedLabels:
    """The label side under a fixed vocabulary, for many batches of companies."""

    features: DataFrame
    grams: DataFrame
    sets: DataFrame = None


def prepare_labels(
    labels: DataFrame,
    vocab: DataFrame,
    settings: Settings = None,
    label_text: str = "cleaned_label",
    synonyms: DataFrame = None,
) -> PreparedLabels:
    """Write label rows and their norms once; without settings for TF-IDF only."""
    counts = materialize(tfidf.term_counts(labels, "label_id", label_text), "label_counts")
    grams = similarity.label_table(labels, vocab, counts, kinds=("gram",))
    if settings is None:
        return PreparedLabels(labels, grams)
    features = _label_features(labels, settings, synonyms)
    return PreparedLabels(features, grams, similarity.label_table(features, kinds=("word", "syn")))


def _label_features(labels: DataFrame, settings: Settings, synonyms: DataFrame) -> DataFrame:
    return materialize(
        similarity.label_features(labels, settings.mode, settings.sectors(), synonyms), "label_features"
    ).withColumn("label", F.col(settings.bonus_on))


# --- TF-IDF only -----------------------------------------------------------

def tfidf_features(
    companies: DataFrame,
    labels: DataFrame,
    key: str = "company_id",
    text: str = "combined_features",
    label_text: str = "cleaned_label",
    vocab: DataFrame = None,
    min_df: float = 1,
    max_df: float = 0.9,
    prepared: PreparedLabels = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(features, label postings, norms)``; a given ``vocab`` is used as is, and
    with it ``prepared`` labels.  Of the companies' n-grams only those that labels have
    become feature rows."""
    feat.require_columns(companies, key, text)
    feat.require_columns(labels, "label_id", label_text)
    texts = gram_norms.key_texts(companies, key, text)
    if prepared is not None:
        rows = similarity.shared_features(texts, key, prepared.grams)
        postings = prepared.grams.select("term", "label_id", "value")
        return rows, postings, gram_norms.norms(texts, key, vocab=vocab)
    label_counts = materialize(tfidf.term_counts(labels, "label_id", label_text), "label_counts")
    rows = similarity.shared_features(texts, key, label_counts)
    if vocab is None:
        n_docs = company_ids(rows, key).count() + labels.count()
        norms = gram_norms.norms(texts, key, n_docs, label_counts, (tfidf.bound(min_df, n_docs), tfidf.bound(max_df, n_docs)))
        # every row of a label's term is here, so the frequencies are whole
        vocab = fit(rows, label_counts, n_docs, min_df, max_df)
    else:
        norms = gram_norms.norms(texts, key, vocab=vocab)
    table = similarity.label_table(labels, vocab, label_counts, kinds=("gram",))
    return rows, table.select("term", "label_id", "value"), norms


def _grams(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("kind") == "gram").select(key, "term", "w")


def cosine(companies: DataFrame, labels: DataFrame, key: str = "company_id", **options) -> DataFrame:
    """``(key, label_id, score)`` of every pair with a positive cosine."""
    rows, postings, norms = tfidf_features(companies, labels, key, **options)
    matched = lookup_join(_grams(rows, key), postings, ["term"], spread=key)
    dots = matched.groupBy(key, "label_id").agg(F.sum(F.col("w") * F.col("value")).alias("dot"))
    return dots.join(norms, key).select(key, "label_id", (F.col("dot") / F.col("norm")).alias("score"))


def top_matches(
    companies: DataFrame,
    labels: DataFrame,
    key: str = "company_id",
    top_k: int = 3,
    threshold: float = 0.05,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """``(ids, matches)`` with the best labels at or above the threshold.

    Only pairs that can be among them are formed (``operators.pruning``).  Ranks
    are taken on rounded cosines, inside the company's bucket.
    """
    ranking.check_top_k(top_k)
    labels = materialize(labels, "taxonomy")
    rows, postings, norms = tfidf_features(companies, labels, key, **options)
    ids = company_ids(rows, key)
    pairs = pruning.best_pairs(_grams(rows, key), norms, postings, key, top_k, threshold)
    scored = pairs.withColumn("score", F.col("dot") / F.col("norm"))
    ranked = ranking.top_k_pairs(scored, [key], "score", top_k).select(key, "label_id", "score", "rank")
    if threshold <= 0:
        ranked = ranking.pad_with_zero_scores(ranked, ids, labels, key, top_k)
    return ids, _named(ranked.where(ranking.at_least("score", threshold)), labels, key)


def tfidf_classify(companies: DataFrame, labels: DataFrame, key: str = "company_id", **options) -> DataFrame:
    """``(key, insurance_labels, insurance_label_scores, insurance_label)``."""
    ids, matches = top_matches(companies, labels, key, **options)
    return _finish(ids, matches, key)


# --- ensemble --------------------------------------------------------------

def ensemble_pairs(
    companies: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    key: str = "company_id",
    text: str = "combined_features",
    synonyms: DataFrame = None,
    vocab: DataFrame = None,
    repeats: dict[str, int] = None,
    best: int = None,
    fitted: list = None,
    prepared: PreparedLabels = None,
) -> tuple[DataFrame, DataFrame]:
    """``(features, components)``: all similarity components per pair.

    Components do not depend on weights, top_k or threshold.  With ``best``,
    pairs that share only sectors are cut to that many labels per sector set:
    no other such pair can be among a company's ``best`` pairs if no weight is
    negative.  A vocabulary fitted here is appended to ``fitted`` with its
    number of documents.
    """
    feat.require_columns(labels, "label_id", "label", "cleaned_label")
    if repeats:
        companies = companies.withColumn(text, feat.combined_text(_enough_copies(repeats, settings)))
    if prepared is None:
        labels = _label_features(labels, settings, synonyms)
        sets = similarity.label_table(labels, kinds=("word", "syn"))
    else:
        labels, sets = prepared.features, prepared.sets
    rows = similarity.company_features(
        companies, key, text, settings.mode, sectors=settings.sectors(),
        synonyms=synonyms, repeats=repeats, wanted=sets,
    )
    own = vocab is None
    if prepared is None:
        label_counts = materialize(tfidf.term_counts(labels, "label_id", "cleaned_label"), "label_counts")
        if own:
            n_docs = company_ids(rows, key).count() + labels.count()
            vocab = fit(rows, label_counts, n_docs, settings.min_df, settings.max_df)
            if fitted is not None:
                fitted.append((vocab, n_docs))
        grams = similarity.label_table(labels, vocab, label_counts, kinds=("gram",))
    else:
        grams = prepared.grams
    sectors = similarity.label_table(
        labels, company_sets=similarity.distinct_sector_sets(rows), kinds=("sectors",)
    )
    table = grams.unionByName(sectors).unionByName(sets)
    if best is None:
        pairs = similarity.pair_components(rows, table, key)
    else:
        pairs = similarity.best_pair_components(rows, table, key, best)
    return rows, similarity.with_tfidf(
        pairs, similarity.company_norms(rows, key, vocab, own), key
    )


def _enough_copies(repeats: dict[str, int], settings: Settings) -> dict[str, int]:
    """Copies per column that the non-gram features can tell from all copies.

    A sector phrase of ``m`` words touches at most ``m`` copies.  The optimized
    mode reads the first ten long words, which ten copies of the first column
    that has any contain; the basic mode reads bigrams and trigrams.
    """
    longest = max((len(k.split()) for ks in settings.sectors().values() for k in ks), default=1)
    needed = max(longest, 10 if settings.mode == "optimized" else 3)
    return {c: min(n, needed) for c, n in repeats.items()}


def prunable(weights: Weights) -> bool:
    """Whether the order by sector score is the order by weighted sector score:
    no weight is negative, and none so small that rounding makes new ties."""
    w = weights.normalized()
    return min(w.tfidf, w.wordnet, w.keyword) >= 0 and not 0 < w.keyword < 1e-4


def ensemble_classify(
    companies: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    key: str = "company_id",
    sector_columns: DataFrame = None,
    **options,
) -> DataFrame:
    """Full classifier; one output row per company."""
    ranking.check_top_k(settings.top_k)
    labels = materialize(labels, "taxonomy")
    best = settings.top_k if prunable(settings.weights) else None
    rows, pairs = ensemble_pairs(companies, labels, settings, key, best=best, **options)
    return rank_and_collect(
        company_ids(rows, key), pairs, labels, settings, key,
        companies if sector_columns is None else sector_columns,
    )


def rank_and_collect(
    ids: DataFrame,
    pairs: DataFrame,
    labels: DataFrame,
    settings: Settings,
    key: str,
    companies: DataFrame,
) -> DataFrame:
    scored = ranking.ensemble_score(pairs, settings.weights)
    ranked = ranking.rescale(
        ranking.top_k_pairs(scored, [key], "raw_score", settings.top_k), [key]
    ).select(key, "label_id", "raw_score", "score", "rank")
    if settings.threshold <= 0:
        ranked = ranking.pad_with_zero_scores(ranked, ids, labels, key, settings.top_k)
    kept = ranking.at_least("score", settings.threshold)
    if settings.ensure_one_tag:
        # whenever any label passes the threshold, the best one does
        kept = kept | (F.col("rank") == 1)
    matches = ranked.where(kept)
    out = ids.join(ranking.label_lists(_named(matches, labels, key), [key]), key, "left")
    if settings.ensure_one_tag:
        out = ranking.fallback_chain(
            out, labels, companies, key,
            settings.require_positive_best, settings.sectors(),
        )
    return ranking.with_label_text(out)


def attach(companies: DataFrame, classified: DataFrame, key: str = "company_id") -> DataFrame:
    """The company table with the label columns."""
    return companies.join(classified, key, "left")
