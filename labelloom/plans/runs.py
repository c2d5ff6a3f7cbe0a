"""Classification runs that persist their results."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame

from labelloom.plans.classify import Settings, attach, ensemble_classify
from labelloom.plans.scratch import materialize, scope
from labelloom.sources import models, sinks


def run_classification(
    companies: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    key: str = "company_id",
    output_path: str = None,
    export_path: str = None,
    model_path: str = None,
    **options,
) -> DataFrame:
    """Classify, save the model, write the full table and the export.

    With ``output_path`` the returned table is the written one, and all
    intermediate tables are deleted.
    """
    spark = companies.sparkSession
    with scope(spark) if output_path else nullcontext():
        fitted: list = []
        labeled = ensemble_classify(companies, labels, settings, key, fitted=fitted, **options)
        out = attach(companies, labeled, key)
        if output_path:
            sinks.write_table(out, output_path)
            out = spark.read.parquet(output_path)
        elif export_path:
            out = materialize(out, "classified")
        if model_path:
            if not fitted:
                raise ValueError("A run under a given vocabulary fits no model to save")
            models.save_model(models.Model(*fitted[0], settings), model_path)
        if export_path:
            sinks.export_labels(out, export_path)
    return out


def run_with_best_trial(
    companies: DataFrame, labels: DataFrame, history_path: str, base: Settings = Settings(), **options
) -> DataFrame:
    """Run with the weights, top_k and threshold of a saved search."""
    settings = models.best_settings(companies.sparkSession, history_path, base)
    return run_classification(companies, labels, settings, **options)
