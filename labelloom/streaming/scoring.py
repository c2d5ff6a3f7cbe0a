"""Scoring new companies with a saved vocabulary, in batches or on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from labelloom.plans.classify import Settings, ensemble_classify, prepare_labels, tfidf_classify
from labelloom.plans.scratch import scope


def score_with_model(
    companies: DataFrame,
    labels: DataFrame,
    vocab: DataFrame,
    settings: Settings = None,
    key: str = "company_id",
    **options,
) -> DataFrame:
    """Classify under a fitted vocabulary: TF-IDF only without settings, the
    ensemble with them.  Unknown terms are ignored."""
    if settings is None:
        return tfidf_classify(companies, labels, key, vocab=vocab, **options)
    return ensemble_classify(companies, labels, settings, key, vocab=vocab, **options)


def score_stream(
    companies: DataFrame,
    labels: DataFrame,
    vocab: DataFrame,
    output_path: str,
    checkpoint: str,
    trigger: dict = None,
    event_time: str = None,
    delay: str = "1 hour",
    key: str = "company_id",
    **options,
) -> StreamingQuery:
    """Score every micro-batch and write it to a folder of its own.

    Label rows and norms are made once, before the stream starts.
    A batch that is replayed after a failure overwrites its folder, so each
    company appears once.

    With ``event_time`` the stream keeps the companies of the last ``delay`` as
    state: one that the source sends again is not scored again, also after a
    restart, and a row older than the watermark is dropped.  State older than
    the watermark is forgotten, so it does not grow with the stream.
    """
    if event_time:
        timed = companies.withColumn(event_time, F.col(event_time).cast("timestamp"))
        companies = timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    prepared = prepare_labels(
        labels, vocab, options.get("settings"), options.get("label_text", "cleaned_label"), options.get("synonyms")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        with scope(batch.sparkSession):
            scored = score_with_model(batch, labels, vocab, key=key, prepared=prepared, **options)
            scored.write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")

    return (
        companies.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
