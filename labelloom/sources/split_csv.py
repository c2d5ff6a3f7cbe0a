"""CSV with line breaks inside quotes, read by many tasks per file.

A line break ends a record only where the quotes before it are even in number.
One pass counts the quotes of every split; a running sum over the splits of a
file, one row each, tells which splits begin inside a quoted field.  A second
pass then walks each split's lines in order, gluing those that belong together,
one record in memory.  What a split cannot finish, at most a beginning and an end,
goes to a small table of fragments and is glued across splits.  The text itself is
never shuffled; records are parsed by ``from_csv``.

A quote inside a quoted field is written twice; a quote elsewhere in an unquoted
field is not supported, as it is not by the format.  Files are UTF-8.
"""

from __future__ import annotations

import csv
import io
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from labelloom.functions.lexicons import NULL_TOKENS
from labelloom.plans.scratch import materialize

WHOLE, HEAD, TAIL = "whole", "head", "tail"
_PIECES = "file long, block long, place long, kind string, closed boolean, text string"
_SPLIT = "spark.sql.files.maxPartitionBytes"


@contextmanager
def split_bytes(spark: SparkSession, size: int | None):
    """Splits of ``size`` bytes inside the block; None keeps the session's size."""
    before = spark.conf.get(_SPLIT)
    try:
        if size:
            spark.conf.set(_SPLIT, str(size))
        yield
    finally:
        spark.conf.set(_SPLIT, before)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # an explicit separator keeps a carriage return inside a field
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("block"), "value"
    )


def _odd_starts(lines: DataFrame) -> DataFrame:
    """``(file, block, odd)``: whether a split begins inside a quoted field."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    sums = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd"))


def _glue(batches):
    """Pieces of records from lines in order; a piece ends where quotes are even.

    The state is what the open piece of the current split holds; rows of one
    split follow each other."""
    at, place, lines, head = None, 0, [], False

    def piece(out, closed):
        nonlocal place, lines, head
        kind = HEAD if head else WHOLE if closed else TAIL
        out.append((*at, place, kind, closed, "\n".join(lines)))
        place, lines, head = place + 1, [], False

    for batch in batches:
        out, first = [], 0
        file, block, odd = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        changes = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
        odd_quotes = pc.bit_wise_and(pc.count_substring(batch.column(2), '"'), 1).to_numpy(zero_copy_only=False)
        for end in [*changes.tolist(), len(file)]:
            if end == first:
                continue
            if at != (int(file[first]), int(block[first])):
                if lines:
                    piece(out, False)
                at, place, head = (int(file[first]), int(block[first])), 0, odd[first].as_py()
                inside = head
            texts = batch.column(2).slice(first, end - first).to_pylist()
            for text, flips in zip(texts, odd_quotes[first:end].tolist()):
                lines.append(text)
                inside ^= bool(flips)
                if not inside:
                    piece(out, True)
            first = end
        if out:
            yield _table(out)
    if lines:
        out = []
        piece(out, False)
        yield _table(out)


def _table(rows):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
    names = [c.split()[0] for c in _PIECES.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def records(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """``(file, block, place, text)`` of every record, header records included, in
    the order of (block, place) within a file; written once."""
    with split_bytes(spark, size):
        lines = _lines(spark, path)
        odd = materialize(_odd_starts(lines), "splits")
        # one row per split; without it the order of lines could not be kept
        marked = lines.join(F.broadcast(odd), ["file", "block"]).select("file", "block", "value", "odd")
        pieces = materialize(marked.mapInArrow(_glue, _PIECES), "csv_pieces")
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "place", "text")
    fragments = pieces.where(F.col("kind") != WHOLE)
    # at most two rows per split take part
    so_far = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0)
    record = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(so_far)
    parts = F.sort_array(F.collect_list(F.struct("block", "place", "text")))
    glued = fragments.withColumn("record", record).groupBy("file", "record").agg(parts.alias("parts"))
    glued = glued.select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["place"].alias("place"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"),
    )
    return whole.unionByName(glued)


def _header(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Records that head a file, and the names they all give."""
    first = Window.partitionBy("file").orderBy("block", "place")
    starts = rows.where((F.col("block") == 0)).where("place = 0").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    texts = [r["text"] for r in starts.select(F.trim("text", F.lit("﻿\r")).alias("text")).distinct().limit(2).collect()]
    if len(texts) > 1:
        raise ValueError("The files have different headers")
    return starts, next(csv.reader(io.StringIO(texts[0]))) if texts else []


def read_csv_split(
    spark: SparkSession, path: str, schema: StructType | str = None, size: int | None = None
) -> DataFrame:
    """``readers.read_csv`` for large files with line breaks inside quotes.

    ``size`` is the bytes of one split (default: the session's).  Without a schema
    every column is a string.  Names of the header must be those of the schema.
    """
    rows = records(spark, path, size)
    starts, names = _header(rows)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if schema is None:
        schema = StructType([StructField(n, StringType()) for n in names])
    elif names and names != schema.names:
        raise ValueError(f"The header {names} does not match the schema {schema.names}")
    body = rows.join(F.broadcast(starts.select("file", "block", "place")), ["file", "block", "place"], "left_anti")
    text = F.rtrim("text", F.lit("\r"))
    options = {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    parsed = body.where(F.trim(text, F.lit(" \t\r")) != "").select(F.from_csv(text, _ddl(schema), options).alias("row"))
    return parsed.select(*[
        F.when(~F.col(f"row.`{f.name}`").isin(NULL_TOKENS), F.col(f"row.`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, StringType) else F.col(f"row.`{f.name}`").alias(f.name)
        for f in schema
    ])


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
