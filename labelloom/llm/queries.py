"""One query per operator of this package, over the whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.llm import (
    chat, decontamination, fingerprints, licenses, lines, lm, packing, pii, quality, repair, runs, sharding, simhash,
)
from labelloom.llm.common import let, table, words
from labelloom.llm.oracle import SQL  # noqa: F401  (read by the driver contract)
from labelloom.plans.joins import lookup_join
from labelloom.plans.scratch import materialize


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(pii.BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k.name) for k in pii.BASE],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", quality.statistics(F.col("text")).alias("s"))
    stats = materialize(docs, "quality")
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rules = quality.fit(stats.join(marks, "doc_id"))
    s = F.col("s")
    return stats.select(
        "doc_id",
        *[s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        quality.base_failed(s).alias("base_failed"),
        rules.kept(s).alias("kept"),
        rules.first_rule(s).alias("rule"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of all preference pairs, with loss masks."""
    pairs = chat.shared_start_pairs(table(spark, sf_dir, "conversations"))
    return chat.format_pairs(*pairs)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and lines that are a known licence text or notice."""
    known = licenses.known_digests(licenses.builtin_texts(spark))
    return licenses.scan(table(spark, sf_dir, "documents"), known)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items leaked into documents."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return lm.score(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a repeated line, and the one that is kept."""
    found = lines.repeated_lines(table(spark, sf_dir, "documents"), shortest=0)
    return found.select(
        "doc_id", F.col("line").cast("long").alias("line"), "kept_doc_id", F.col("kept_line").cast("long").alias("kept_line"), "kept"
    )


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with the ends of every tenth text made periodic: from word a on, its
    words a to a + p - 1 come again and again."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def periodic(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), tail), " ")).otherwise("")

    return docs.withColumn("text", F.when(h % 10 == 0, let(words(F.col("text")), periodic)).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and the text without them."""
    docs = with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    found = runs.periodic_runs(docs).withColumn("best", longest)
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with turns dropped, emptied, stripped of their ends,
    repeated and given to the user, by a checksum of their place."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(filled["conv_id"], F.lit(":"), filled["turn"])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled["text"], ".!?", "")).otherwise(filled["text"])
    role = F.when(kind == 4, "user").otherwise(filled["role"])
    rows = conversations.where(kind != 0)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and what it gives."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    summaries, turns = repair.repair(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    for part in (summaries, repair.digests(turns)):
        part = part.withColumnRenamed("conv_id", "_conv")
        every = every.join(part, every["conv_id"].eqNullSafe(part["_conv"]), "left").drop("_conv")
    return every.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    prints = fingerprints.beside_next(table(spark, sf_dir, "documents"))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    found = lookup_join(prints, fingerprints.near_documents(prints), ["fp"], "doc_id", "left")
    return found.select(
        "doc_id",
        F.col("n_chars"),
        "edited_sha256",
        hexed("fp").alias("fingerprint"),
        hexed("edited_fp").alias("edited_fingerprint"),
        fingerprints.likeness("fp", "edited_fp").alias("near_edited"),
        fingerprints.likeness("fp", "next_fp").alias("near_next"),
        "n_near",
    )


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_simhash": op4_simhash,
    "op5_lm_scores": op5_lm_scores,
    "op6_packing": op6_packing,
    "op7_chat_format": op7_chat_format,
    "op8_sharding": op8_sharding,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_document_fingerprints": op13_document_fingerprints,
}
