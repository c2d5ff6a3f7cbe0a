"""Document frequencies that grow with the corpus, in versions.

A version is the documents that one call added or removed: a table ``(term, df)``
of theirs alone, and one row in ``versions`` with their number.  Any version is
the sum of the tables up to it, so new documents cost a count of their own terms
and nothing is fitted again.  Pruning and idf follow from the sums when a
vocabulary is read.  ``compact`` writes such a sum once, for later reads to start
from.

A version counts only when its row is there: a write that fails half-way leaves
a folder that nobody reads and that the next call replaces.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.operators import tfidf
from labelloom.operators.features import require_columns
from labelloom.plans.scratch import materialize
from labelloom.sources.readers import exists

_VERSIONS = "version long, n_docs long, compacted boolean"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``(version, n_docs, compacted)``; documents of removing versions are negative."""
    if not exists(spark, f"{path}/versions"):
        return spark.createDataFrame([], _VERSIONS)
    return spark.read.schema(_VERSIONS).parquet(f"{path}/versions")


def latest(spark: SparkSession, path: str) -> int:
    """The greatest version, 0 for a store without any."""
    return versions(spark, path).agg(F.max("version")).first()[0] or 0


def _note(spark: SparkSession, path: str, version: int, n_docs: int, compacted: bool) -> None:
    row = spark.createDataFrame([(version, n_docs, compacted)], _VERSIONS)
    row.coalesce(1).write.mode("append").parquet(f"{path}/versions")


def add(frequencies: DataFrame, n_docs: int, path: str, remove: bool = False) -> int:
    """Append the ``(term, df)`` of ``n_docs`` documents as a new version; with
    ``remove`` they leave the corpus instead."""
    require_columns(frequencies, "term", "df")
    if n_docs < 0:
        raise ValueError("n_docs must not be negative")
    spark, sign = frequencies.sparkSession, -1 if remove else 1
    version = latest(spark, path) + 1
    rows = frequencies.select("term", (F.lit(sign) * F.col("df")).cast("long").alias("df"))
    rows.write.mode("overwrite").parquet(f"{path}/changes/version={version}")
    _note(spark, path, version, sign * n_docs, False)
    return version


def add_documents(
    docs: DataFrame, path: str, key: str = "company_id", text: str = "combined_features", remove: bool = False
) -> int:
    """Count the terms of ``docs`` (one row per document) and add them."""
    counts = tfidf.term_counts(docs, key, text)
    return add(tfidf.document_frequency(counts), docs.count(), path, remove)


def frequencies(spark: SparkSession, path: str, version: int = None) -> tuple[DataFrame, int]:
    """``(term, df)`` and the number of documents of the corpus at a version."""
    known = versions(spark, path).collect()  # one row per version
    last = max((r["version"] for r in known), default=0)
    version = last if version is None else version
    if not 0 < version <= last:
        raise ValueError(f"No version {version} in {path}")
    base = max((r["version"] for r in known if r["compacted"] and r["version"] <= version), default=0)
    changes = [r["version"] for r in known if not r["compacted"] and base < r["version"] <= version]
    folders = [f"{path}/changes/version={v}" for v in sorted(changes)] + [f"{path}/sums/version={base}"] * bool(base)
    n_docs = sum(r["n_docs"] for r in known if not r["compacted"] and r["version"] <= version)
    rows = spark.read.schema("term string, df long").parquet(*folders)
    if len(folders) > 1:
        rows = rows.groupBy("term").agg(F.sum("df").alias("df"))
    return rows.where("df > 0"), n_docs


def compact(spark: SparkSession, path: str) -> int:
    """Write the sums of the latest version."""
    rows, _ = frequencies(spark, path)
    version = latest(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/sums/version={version}")
    _note(spark, path, version, 0, True)
    return version


def vocabulary(
    spark: SparkSession, path: str, version: int = None, min_df: float = 1, max_df: float = 0.9
) -> tuple[DataFrame, int]:
    """``(term, df, idf)`` as ``tfidf.vocabulary`` gives it, and the number of documents."""
    rows, n_docs = frequencies(spark, path, version)
    return materialize(tfidf.vocabulary(rows, n_docs, min_df, max_df), "vocabulary"), n_docs
