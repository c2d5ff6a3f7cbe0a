"""Scan of a lexical database in its public text layout.

``index.<pos>`` has one line per term: term, part of speech, number of synsets,
pointer symbols, sense counts and the offsets of its synsets, most used first.
``data.<pos>`` has one line per synset: offset, file number, type, number of words
(two hexadecimal digits), then word and id in turn, and more.  ``noun.exc`` lists
irregular forms with their lemmas.  Lines of the licence start with a blank.

Both tables are read as plain text, which Spark splits, and linked by part of
speech and offset.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from labelloom.operators.lemmas import LemmaRules
from labelloom.plans.joins import lookup_join
from labelloom.sources.readers import exists

# File endings in the order in which a term's synsets are listed.
PARTS_OF_SPEECH = ["noun", "verb", "adj", "adv"]


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.startswith("value", F.lit(" ")) & (F.trim("value") != ""))
    return lines.select(F.split(F.trim("value"), " +").alias("f"))


def _number(at: Column) -> Column:
    return at.cast("int")


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(term, sense, offset)``, senses counted from 1."""
    f = F.col("f")
    count = _number(F.get(f, F.lit(2)))
    offsets = F.slice(f, F.size(f) - count + 1, count)
    rows = _fields(spark, path).select(F.lower(F.replace(f[0], F.lit("_"), F.lit(" "))).alias("term"), F.posexplode(offsets).alias("sense", "offset"))
    return rows.select("term", (F.col("sense") + 1).alias("sense"), "offset")


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(offset, lemma_rank, lemma)``, words counted from 1, without the marks of
    their place in a sentence."""
    f = F.col("f")
    count = F.conv(F.get(f, F.lit(3)), 16, 10).cast("int")
    words = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.get(f, 4 + 2 * i))
    rows = _fields(spark, path).where(F.size(f) > 4).select(f[0].alias("offset"), F.posexplode(words).alias("rank", "word"))
    return rows.select("offset", (F.col("rank") + 1).alias("lemma_rank"), F.regexp_replace("word", r"\(.*\)$", "").alias("lemma"))


def read_synsets(spark: SparkSession, folder: str) -> DataFrame:
    """``(term, synset_rank, lemma_rank, lemma)`` over all parts of speech present;
    a term's synsets are ranked by part of speech, then as its index lists them."""
    parts = []
    for order, name in enumerate(PARTS_OF_SPEECH):
        index, data = (os.path.join(folder, f"{kind}.{name}") for kind in ("index", "data"))
        if exists(spark, index) and exists(spark, data):
            parts.append((index_lines(spark, index).withColumn("part", F.lit(order)), data_lines(spark, data).withColumn("part", F.lit(order))))
    if not parts:
        raise FileNotFoundError(f"No index and data files in {folder}")
    senses, words = (rows[0] for rows in zip(*parts))
    for more_senses, more_words in parts[1:]:
        senses, words = senses.unionAll(more_senses), words.unionAll(more_words)
    rank = F.row_number().over(Window.partitionBy("term").orderBy("part", "sense"))
    ranked = senses.withColumn("synset_rank", rank)
    return lookup_join(ranked, words, ["part", "offset"], spread="term").select("term", "synset_rank", "lemma_rank", "lemma")


def read_lemma_rules(spark: SparkSession, folder: str) -> LemmaRules:
    """Noun lemmas and irregular nouns for ``operators.lemmas``."""
    f = F.col("f")
    index = _fields(spark, os.path.join(folder, "index.noun")).select(f[0].alias("lemma"))
    path = os.path.join(folder, "noun.exc")
    if not exists(spark, path):
        return LemmaRules(index)
    rows = _fields(spark, path).select(f[0].alias("surface"), F.posexplode(F.slice(f, 2, F.size(f))).alias("rank", "lemma"))
    return LemmaRules(index, rows)
