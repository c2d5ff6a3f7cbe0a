"""Preprocessing of company and taxonomy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelloom.functions.arrays import ngrams, words
from labelloom.operators import features
from labelloom.sources import readers, sinks

# Raw company columns and their cleaned names.
COMPANY_COLUMNS = {
    "description": "cleaned_description",
    "business_tags": "cleaned_tags",
    "sector": "cleaned_sector",
    "category": "cleaned_category",
    "niche": "cleaned_niche",
}


def preprocess_companies(
    df: DataFrame,
    key: str = "company_id",
    lemmas: DataFrame = None,
    combined: bool = True,
    **options,
) -> DataFrame:
    """Cleaned columns, description n-grams, combined text, industry flags.

    ``combined=False`` leaves out the repeated text; the classifier counts its
    terms from the cleaned columns.
    """
    present = {s: d for s, d in COMPANY_COLUMNS.items() if s in df.columns}
    out = features.clean_columns(df, present, key, lemmas, **options)
    if "description" in present:
        out = out.withColumn("_w", words(F.col("cleaned_description")))
        out = out.withColumns({
            "description_bigrams": ngrams(F.col("_w"), 2),
            "description_trigrams": ngrams(F.col("_w"), 3),
        }).drop("_w")
    if combined:
        out = out.withColumn(
            "combined_features", features.combined_text(features.repeat_plan(out))
        )
    if "description" in present:
        out = features.industry_keywords(out, "cleaned_description")
    return out


def preprocess_taxonomy(
    df: DataFrame, key: str = "label_id", lemmas: DataFrame = None, **options
) -> DataFrame:
    present = {
        s: d
        for s, d in (("label", "cleaned_label"), ("description", "cleaned_description"))
        if s in df.columns
    }
    out = features.clean_columns(df, present, key, lemmas, **options)
    return features.label_keywords(out) if "label" in present else out


def process_table(
    df: DataFrame,
    name_column: str = None,
    description_column: str = "description",
    employees_column: str = None,
    location_column: str = None,
    enhanced: bool = True,
    output_path: str = None,
    **options,
) -> DataFrame:
    """Generic preprocessing of one table; absent columns are skipped."""
    if name_column in df.columns:
        df = features.clean_names(df, name_column)
    if enhanced:
        df = preprocess_companies(df, **options)
    elif description_column in df.columns:
        df = features.industry_keywords(df, description_column)
    if employees_column in df.columns:
        df = features.size_category(df, employees_column)
    if location_column in df.columns:
        df = features.normalize_location(df, location_column)
    if output_path:
        sinks.write_table(df, output_path)
    return df


def process_files(
    spark,
    company_path: str,
    taxonomy_path: str,
    company_output: str = None,
    taxonomy_output: str = None,
    reuse: bool = False,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Read, preprocess and optionally write both tables.  ``reuse`` loads the
    two outputs instead when both exist already."""
    if reuse and company_output and taxonomy_output:
        saved = readers.load_if_present(spark, company_output, taxonomy_output)
        if saved is not None:
            return saved
    companies, taxonomy = readers.load_two_tables(spark, company_path, taxonomy_path)
    companies = preprocess_companies(companies, **options)
    taxonomy = preprocess_taxonomy(taxonomy, **options)
    if company_output:
        sinks.write_table(companies, company_output)
    if taxonomy_output:
        sinks.write_table(taxonomy, taxonomy_output)
    return companies, taxonomy
