"""Writers for processed tables, classified tables, exports and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from labelloom.operators.evaluation import evaluation_report


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet keeps arrays; CSV gets them as JSON text."""
    if fmt == "csv":
        flat = df.select(*[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (ArrayType, MapType, StructType))
            else F.col(f"`{f.name}`")
            for f in df.schema
        ])
        (
            flat.write.mode(mode).option("header", True)
            .option("quote", '"').option("escape", '"').csv(path)
        )
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"Unsupported output format: {fmt}")


def four_decimals(score: Column) -> Column:
    """Text of a score of zero or more with four decimals, rounded as the exact
    binary value asks for and to the even digit when that is a tie (Spark's own
    formatting rounds the shortest decimal form, ties away from zero)."""
    n = F.floor(score * 10_000)
    # exact: the upper half has 24 bits, the lower 29, and 20,000 adds 15
    upper = score.cast("float").cast("double")
    over = (upper * 20_000 - (2 * n + 1)) + (score - upper) * 20_000
    n = n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)
    return F.format_string("%d.%04d", F.floor(n / 10_000), n % 10_000)


def export_table(
    df: DataFrame, description_column: str = "description", include_scores: bool = False
) -> DataFrame:
    """Description and label text, plus sector, niche, category if present."""
    if description_column not in df.columns:
        raise ValueError(f"The table has no column {description_column} to export")
    columns = [F.col(description_column).alias("description"), F.col("insurance_label")]
    columns += [F.col(c) for c in ("sector", "niche", "category") if c in df.columns]
    if include_scores and "insurance_label_scores" in df.columns:
        columns.append(
            F.array_join(
                F.transform("insurance_label_scores", four_decimals),
                ", ",
            ).alias("label_scores")
        )
    return df.select(*columns)


def export_labels(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    write_table(export_table(df, **options), path, "csv", mode)


def write_report(classified: DataFrame, path: str, key: str = "company_id", mode: str = "errorifexists") -> None:
    """Report rows ``(section, metric, value)`` as CSV."""
    write_table(evaluation_report(classified, key), path, "csv", mode)
