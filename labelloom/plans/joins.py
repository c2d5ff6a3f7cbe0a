"""Joins of a large table with a table that is usually small.

The small side is broadcast only after its rows and bytes have been counted.
Beyond the bound the join shuffles, and hot keys are salted so that no key is
tied to one task.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from labelloom.plans.scratch import materialize, shuffle_width

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEYS = 20_000


def _octets(field) -> Column:
    """About the bytes of a value: exact for text, as JSON for nested values."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return F.lit(8)


def fits_broadcast(df: DataFrame, rows: int = None, size: int = None) -> bool:
    """True when ``df`` has at most ``rows`` rows and ``size`` bytes.

    Every task counts its own rows; nothing is gathered for the check.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    size = BROADCAST_BYTES if size is None else size
    octets = reduce(add, [_octets(f) for f in df.schema], F.lit(0))
    seen, total = df.select(octets.alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return seen <= rows and total <= size


def hot_keys(big: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that own more than ``1 / HOT_KEYS`` of the rows, with the number of
    salts that their share asks for.  At most ``HOT_KEYS`` keys can do so,
    whatever the data looks like."""
    counts = materialize(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "key_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # a salted part holds at most a quarter of an even partition
    salts = F.ceil(F.col("n") * (4 * shuffle_width(big)) / F.lit(max(total, 1))).cast("int")
    return counts.where(F.col("n") * HOT_KEYS > total).select(*keys, salts.alias("_salts"))


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread: str,
    how: str = "inner",
) -> DataFrame:
    """``big`` joined with ``small`` on ``keys``; ``how`` is inner or left.

    ``spread`` is a column of ``big`` that differs between the rows of one key.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"Unsupported join type: {how}")
    if fits_broadcast(small):
        return big.join(F.broadcast(small), keys, how)
    hot = F.broadcast(hot_keys(big, keys))
    salts = F.coalesce("_salts", F.lit(1))
    salted_big = big.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), salts).cast("int")
    ).drop("_salts")
    salted_small = small.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    ).drop("_salts")
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt")
