"""Expressions and small steps that several operators of this package share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\f\r"
_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _GAP), lambda w: w != "")


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def keep_row(df: DataFrame, **more: Column) -> DataFrame:
    """``df`` as one struct column ``row`` beside computed columns, so that no
    computed name can clash with a column of the caller."""
    return df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()]
    )


def spread(df: DataFrame) -> int:
    """Shuffle partitions of the session, which follow the size of the data."""
    return max(
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        df.sparkSession.sparkContext.defaultParallelism,
    )


def numbered(rows: DataFrame, key: str, counts: dict, order: list[str]) -> DataFrame:
    """``rows`` with ``number``: 0, 1, ... within each value of ``key``.

    ``counts`` has the rows of every value (bounded by the caller).  Values are
    split into groups that are small against a task's share of all rows.
    """
    spark, total = rows.sparkSession, sum(counts.values())
    share = max(32, total // (8 * spread(rows)))
    groups = spark.createDataFrame([(k, -(-n // share)) for k, n in counts.items()], "k long, parts long")
    dealt = (
        rows.join(F.broadcast(groups), rows[key] == F.col("k"))
        .withColumn("part", F.pmod(F.xxhash64(*order), F.col("parts")))
        .drop("k", "parts")
    )
    before = (
        dealt.groupBy(key, "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy(key).orderBy("part")) - F.col("n"))
        .drop("n")
    )
    inside = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)) - 1
    return (
        dealt.withColumn("inside", inside)
        .join(before, [key, "part"])
        .withColumn("number", F.col("before") + F.col("inside"))
        .drop("part", "inside", "before")
    )
