"""Saved vocabularies, settings and trial histories."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from labelloom.operators.features import require_columns
from labelloom.operators.lexicon import sector_table
from labelloom.operators.ranking import Weights
from labelloom.plans.classify import Settings

@dataclass(frozen=True)
class Model:
    """A fitted classifier: vocabulary, documents behind it, and settings."""

    vocab: DataFrame
    n_docs: int
    settings: Settings


def save_vocabulary(vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    require_columns(vocab, "term", "df", "idf")
    vocab.select("term", "df", "idf").write.mode(mode).parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    vocab = spark.read.parquet(path)
    require_columns(vocab, "term", "df", "idf")
    return vocab


def save_settings(spark: SparkSession, settings: Settings, path: str, mode: str = "errorifexists") -> None:
    """All fields; the weights as they are, the sector lexicon as a table."""
    w = settings.weights
    fields = [f.name for f in dataclasses.fields(settings) if f.name not in ("weights", "sector_lexicon")]
    values = {f: getattr(settings, f) for f in fields}
    # a float limit is a share and an integer one a count, which must survive
    values |= {f"{f}_is_share": isinstance(values[f], float) for f in ("min_df", "max_df")}
    values |= {"tfidf_weight": w.tfidf, "wordnet_weight": w.wordnet, "keyword_weight": w.keyword}
    values["own_lexicon"] = settings.sector_lexicon is not None
    row = Row(**{k: float(v) if k in ("min_df", "max_df") else v for k, v in values.items()})
    spark.createDataFrame([row]).write.mode(mode).parquet(f"{path}/settings")
    sector_table(spark, settings.sectors()).write.mode(mode).parquet(f"{path}/sectors")


def load_settings(spark: SparkSession, path: str) -> Settings:
    row = spark.read.parquet(f"{path}/settings").first().asDict()
    lexicon = None
    if row.pop("own_lexicon"):
        lexicon = {}
        # as long as the lexicon that was given to the settings as a dict
        for r in spark.read.parquet(f"{path}/sectors").orderBy("sector_pos", "pos").collect():
            lexicon.setdefault(r["sector"], []).append(r["keyword"])
    weights = Weights(*[row.pop(f"{k}_weight") for k in ("tfidf", "wordnet", "keyword")])
    for limit in ("min_df", "max_df"):
        row[limit] = row[limit] if row.pop(f"{limit}_is_share") else int(row[limit])
    return Settings(weights=weights, sector_lexicon=lexicon, **row)


def save_model(model: Model, path: str, mode: str = "errorifexists") -> None:
    spark = model.vocab.sparkSession
    save_vocabulary(model.vocab, f"{path}/vocabulary", mode)
    spark.createDataFrame([(model.n_docs,)], "n_docs long").write.mode(mode).parquet(f"{path}/documents")
    save_settings(spark, model.settings, path, mode)


def load_model(spark: SparkSession, path: str) -> Model:
    return Model(
        load_vocabulary(spark, f"{path}/vocabulary"),
        spark.read.parquet(f"{path}/documents").first()["n_docs"],
        load_settings(spark, path),
    )


def save_history(history: DataFrame, path: str, mode: str = "errorifexists") -> None:
    history.write.mode(mode).parquet(path)


def best_settings(spark: SparkSession, path: str, base: Settings = Settings()) -> Settings:
    """Settings of the best trial of a saved search."""
    best = spark.read.parquet(path).orderBy(F.round("score", 9).desc(), "trial_id").first()
    if best is None:
        raise ValueError(f"No trials in {path}")
    return dataclasses.replace(
        base, top_k=best["top_k"], threshold=best["threshold"],
        weights=Weights(best["tfidf_weight"], best["wordnet_weight"], best["keyword_weight"]),
    )
