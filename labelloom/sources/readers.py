"""Readers for company, taxonomy and result files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructType

from labelloom.functions.arrays import label_list, score_list
from labelloom.functions.lexicons import NULL_TOKENS
from labelloom.plans.scratch import materialize, positions


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str = None, multiline: bool | str = True
) -> DataFrame:
    """CSV with quoted fields; null tokens become null.

    Without a schema every column is a string, so no inference pass runs.
    By default line breaks inside quotes survive, and a file is one task.
    ``multiline="split"`` reads such files by many tasks each (see ``split_csv``);
    ``multiline=False`` lets Spark split large files that have no line break
    inside a quoted field.
    """
    if multiline == "split":
        from labelloom.sources.split_csv import read_csv_split

        return read_csv_split(spark, path, schema)
    reader = (
        spark.read.option("header", True).option("multiLine", multiline)
        .option("quote", '"').option("escape", '"')
        .option("enforceSchema", False)
    )
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.select(*[
        F.when(~F.col(f"`{f.name}`").isin(NULL_TOKENS), F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def read_json(
    spark: SparkSession, path: str, schema: StructType | str = None, lines: bool = False
) -> DataFrame:
    """An array of records, or with ``lines=True`` one record per line (which
    Spark can split)."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def load_data(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """Choose the reader by file extension."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension == ".csv":
        return read_csv(spark, path, schema, **options)
    if extension == ".json":
        return read_json(spark, path, schema, **options)
    if extension == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file extension: {extension}")


def with_company_id(df: DataFrame, name: str = "company_id") -> DataFrame:
    """Key for a table that has none: a digest of the row, made unique for
    copies.  The table is written once so that the key cannot change later."""
    if name in df.columns:
        return df
    digest = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    copy = F.monotonically_increasing_id()
    return materialize(df.withColumn(name, F.concat_ws("-", digest, copy)), "companies")


def with_label_id(df: DataFrame, name: str = "label_id", order_by: str = None) -> DataFrame:
    """0-based position of each label, in the order of files and lines; its order
    matters in ties.  With ``order_by`` the position follows that column.

    Splits are numbered by file name and offset, rows inside their split; only
    one count per split is added up in one task.
    """
    if name in df.columns:
        return df
    if order_by is not None:
        return positions(df, [order_by], name).withColumn(name, F.col(name).cast("bigint"))
    rows = materialize(
        df.withColumns({
            "_file": F.input_file_name(),
            "_block": F.input_file_block_start(),
            "_at": F.monotonically_increasing_id(),
        }),
        "taxonomy",
    )
    counts = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("_file", "_block")
    before = counts.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")) - 1
    placed = rows.withColumn("_inside", inside).join(before, ["_file", "_block"])
    numbered = placed.select(*df.columns, (F.col("_before") + F.col("_inside")).cast("bigint").alias(name))
    return numbered.orderBy(name)


def load_two_tables(
    spark: SparkSession, company_path: str, taxonomy_path: str, **options
) -> tuple[DataFrame, DataFrame]:
    companies = with_company_id(load_data(spark, company_path, **options))
    return companies, with_label_id(load_data(spark, taxonomy_path, **options))


def load_processed(spark: SparkSession, path: str) -> DataFrame:
    """Reload a processed table; arrays keep their types."""
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def load_if_present(spark: SparkSession, *paths: str) -> tuple[DataFrame, ...] | None:
    """The processed tables, or None unless all of them exist."""
    if not all(exists(spark, path) for path in paths):
        return None
    return tuple(load_processed(spark, p) for p in paths)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Classified results from Parquet or CSV; a missing path raises.  List
    cells of a CSV file are parsed back into arrays."""
    if os.path.splitext(path.rstrip("/"))[1].lower() != ".csv":
        return spark.read.parquet(path)
    return parse_result_cells(read_csv(spark, path))


def parse_result_cells(df: DataFrame) -> DataFrame:
    if "insurance_labels" in df.columns:
        df = df.withColumn("insurance_labels", label_list(F.col("insurance_labels")))
    elif "insurance_label" in df.columns:
        df = df.withColumn("insurance_labels", label_list(F.col("insurance_label")))
    if "insurance_label_scores" in df.columns:
        df = df.withColumn("insurance_label_scores", score_list(F.col("insurance_label_scores")))
    return df
