"""TF-IDF over long posting tables.

Vectors are rows ``(key, term, weight)``, the vocabulary is a table
``(term, df, idf)``; nothing is collected to the driver but the document count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.functions.arrays import counted, ngram_range, unnest, vector_tokens
from labelloom.operators.features import require_columns
from labelloom.plans.joins import HOT_KEYS, fits_broadcast, hot_keys
from labelloom.plans.scratch import materialize, shuffle_width

#: Bits of a term filter: at most 2**20 rows of 64 bits are broadcast.
FILTER_BITS = 1 << 26


def corpus(
    companies: DataFrame,
    taxonomy: DataFrame,
    company_key: str = "company_id",
    company_text: str = "combined_features",
    label_key: str = "label_id",
    label_text: str = "cleaned_label",
) -> DataFrame:
    """Company texts and label texts as one table ``(side, id, text)``."""
    require_columns(companies, company_key, company_text)
    require_columns(taxonomy, label_key, label_text)

    def side(df, name, key, text):
        return df.select(
            F.lit(name).alias("side"),
            F.col(key).cast("string").alias("id"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )

    return side(companies, "company", company_key, company_text).unionAll(
        side(taxonomy, "label", label_key, label_text)
    )


def term_counts(
    df: DataFrame, key: str, text: str, ngrams: tuple[int, int] = (1, 3)
) -> DataFrame:
    """``(key, term, tf)``.

    The raw text is spread by key once; its n-grams, several times longer, are
    then counted inside their partition without a shuffle of their own.  Those of a
    text that is the only one of its key are counted inside their row; only texts
    that share a key are grouped by term.
    """
    require_columns(df, key, text)
    spread = df.select(key, text).repartition(shuffle_width(df), key)
    spread = spread.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(key)))
    tokens = spread.select(key, "_same", vector_tokens(F.col(text)).alias("_t"))
    grams = ngram_range(F.col("_t"), *ngrams)
    alone = unnest(tokens.where("_same = 1"), [key], counted(grams), "_c").select(
        key, F.col("_c.term").alias("term"), F.col("_c.tf").alias("tf")
    )
    shared = unnest(tokens.where("_same > 1"), [key], grams, "term")
    return alone.unionAll(shared.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))


def sublinear(tf: Column) -> Column:
    return F.lit(1.0) + F.log(tf)


def document_frequency(*counts: DataFrame) -> DataFrame:
    """``(term, df)`` over several posting tables; partial counts are combined
    before the shuffle."""
    rows = counts[0].select("term")
    for other in counts[1:]:
        rows = rows.unionAll(other.select("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bound(limit: float, n_docs: int) -> float:
    return limit * n_docs if isinstance(limit, float) else limit


def vocabulary(
    frequencies: DataFrame, n_docs: int, min_df: float = 1, max_df: float = 0.9
) -> DataFrame:
    """``(term, df, idf)``; ``idf`` is null for pruned terms.  A float limit is
    a share of the documents, an integer a count."""
    df = F.col("df")
    kept = (df >= bound(min_df, n_docs)) & (df <= bound(max_df, n_docs))
    idf = F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + df)) + 1.0
    return frequencies.withColumn("idf", F.when(kept, idf))


def kept_terms(vocab: DataFrame) -> DataFrame:
    return vocab.where(F.col("idf").isNotNull())


def term_filter(terms: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Bits ``(_word, _bits)`` of the hashed ``terms``, 64 a row, and their number.

    About sixteen bits a term up to ``FILTER_BITS``, so that they may be
    broadcast whatever ``count`` is; more terms only make the filter less sharp.
    """
    size = 64
    while size < min(16 * count, FILTER_BITS):
        size *= 2
    slot = F.xxhash64("term").bitwiseAND(size - 1)
    bit = F.expr("shiftleft(1L, cast(_slot & 63 AS int))")
    words = terms.select(slot.alias("_slot")).select(F.shiftright("_slot", 6).alias("_word"), bit.alias("_bit"))
    return words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), size


def with_filter_bit(postings: DataFrame, words: DataFrame, size: int, name: str) -> DataFrame:
    """``postings`` with ``name``: false only for terms that the filter has not seen."""
    marked = postings.withColumn("_slot", F.xxhash64("term").bitwiseAND(size - 1))
    marked = marked.withColumn("_word", F.shiftright("_slot", 6)).join(F.broadcast(words), "_word", "left")
    bit = F.getbit("_bits", F.col("_slot").bitwiseAND(63).cast("int"))
    return marked.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_slot", "_word", "_bits")


def weigh(
    postings: DataFrame,
    vocab: DataFrame,
    own_corpus: bool = True,
) -> DataFrame:
    """``postings`` with the ``idf`` of their term; pruned and unknown terms go.

    A vocabulary within the broadcast bound is broadcast.  Beyond it, terms
    that own more than ``1 / HOT_KEYS`` of all postings (there cannot be more
    than ``HOT_KEYS`` of them) are broadcast, and only the other terms, none of
    which is large, are joined by a shuffle.

    ``own_corpus`` says that ``vocab`` was counted on these postings.  Then its
    ``df`` already tells which terms are hot, and the many terms that occur in
    one document only, which share one idf, stay out of the shuffle: a broadcast
    bitmap of the terms of several documents tells nearly all of them.
    """
    known = kept_terms(vocab).select("term", "idf")
    if fits_broadcast(known):
        return postings.join(F.broadcast(known), "term")
    if not own_corpus:
        # most terms of other texts are unknown and need not be counted or shuffled
        words, size = term_filter(known, known.count())
        postings = with_filter_bit(postings, words, size, "_known").where("_known").drop("_known")
        hot = hot_keys(postings, ["term"]).select("term")
        hot_idf = known.join(F.broadcast(hot), "term", "left_semi")
        cold = postings.join(F.broadcast(hot), "term", "left_anti")
        return postings.join(F.broadcast(hot_idf), "term").unionByName(cold.join(known, "term"))
    once = F.col("df") == 1
    total, several, single = vocab.agg(F.sum("df"), F.count(F.when(~once, 1)), F.max(F.when(once, F.col("idf")))).first()
    single_idf = F.lit(single).cast("double")
    repeated = vocab.where(F.col("df") > 1).select("term", "idf", F.lit(True).alias("_seen"))
    hot = repeated.join(
        F.broadcast(vocab.where(F.col("df") * HOT_KEYS > total).select("term")), "term", "left_semi"
    ).withColumnRenamed("_seen", "_hot")
    words, size = term_filter(repeated, several)
    marked = with_filter_bit(postings.join(F.broadcast(hot), "term", "left"), words, size, "_several")
    is_hot = F.coalesce("_hot", F.lit(False))
    local = marked.where(is_hot | ~F.col("_several")).withColumn(
        "idf", F.when(is_hot, F.col("idf")).otherwise(single_idf)
    )
    shuffled = (
        marked.where(~is_hot & F.col("_several")).drop("idf")
        .join(repeated, "term", "left")
        .withColumn("idf", F.when(F.col("_seen"), F.col("idf")).otherwise(single_idf))
    )
    both = local.drop("_hot", "_several").unionByName(shuffled.drop("_hot", "_several", "_seen"))
    return both.where(F.col("idf").isNotNull())


def norms(weights: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    return weights.groupBy(key).agg(
        F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm")
    )


def unit_vectors(counts: DataFrame, key: str, vocab: DataFrame, own_corpus: bool = True) -> DataFrame:
    """L2-normalized ``(key, term, weight)``.  The weights are shuffled by key once,
    for norm and result; rows without a key have no vector."""
    raw = weigh(counts, vocab, own_corpus).where(F.col(key).isNotNull()).select(
        key, "term", (sublinear(F.col("tf")) * F.col("idf")).alias("weight")
    ).repartition(shuffle_width(counts), key)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("weight") / norm).alias("weight"))


def transform(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """Vectors of new texts under a fitted vocabulary."""
    require_columns(vocab, "term", "idf")
    # only what the vocabulary may have is written, far less than all n-grams
    known = kept_terms(vocab)
    words, size = term_filter(known, known.count())
    counts = with_filter_bit(term_counts(df, key, text), words, size, "_known").where("_known").drop("_known")
    counts = materialize(counts, "counts")
    return unit_vectors(counts, key, vocab, own_corpus=False)
