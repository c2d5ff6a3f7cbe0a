"""The driver tables in the roles of companies, labels and lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from labelloom.functions import arrays as A
from labelloom.functions import text as T
from labelloom.operators import ranking
from labelloom.operators.lemmas import LemmaRules
from labelloom.plans.scratch import widen
from labelloom.sources.readers import with_label_id

# literal tails that give the prose something to clean, picked by key
TAILS = [
    "",
    " We sell P&C, WC wc and GL cover; cyber too.",
    " E-commerce, Third-Party and cyber-security for b2b/B2C clients.",
    " See http://example.com/a?b=1 or www.example.org, mail info.desk@mail-1.example.com now",
    " D&O, A&H; E&O ltc UL pi piano glue wcx",
    " Health & Safety, property & casualty insurance risk policies, business-to-business.",
]
SUFFIX_NAMES = [
    " Inc.", " LLC", " Ltd", " Corp", " Corporation", " Limited", " GmbH", " PLC",
    " LP", " LLP", " SA", " AG", " BV", " SRL", " SpA", " NV", " & Co. o'neil-x",
]
PART_SECTORS = {
    "fasteners": ["bolt", "ring", "rod"],
    "plates": ["plate", "anvil"],
    "machines": ["gear", "gizmo", "large widget", "small widget"],
    "thermal": ["hot", "cold", "hot plate"],
    "age": ["old", "new"],
    "size": ["large", "small", "medium"],
    "tier": ["economy", "promo", "standard"],
}
SYNONYMS = [
    ("ring", 1, 1, "ring"), ("ring", 1, 2, "band"), ("ring", 1, 3, "hoop"), ("ring", 1, 4, "circle"),
    ("ring", 2, 1, "sound"), ("ring", 3, 1, "arena"),
    ("bolt", 1, 1, "bolt"), ("bolt", 1, 2, "fastener"), ("bolt", 2, 1, "lightning_bolt"), ("bolt", 2, 2, "rod"),
    ("gear", 1, 1, "cog"), ("gear", 1, 2, "gear_wheel"), ("gear", 2, 1, "equipment"), ("gear", 2, 2, "gizmo"),
    ("gizmo", 1, 1, "gadget"), ("gizmo", 1, 2, "widget"), ("gizmo", 1, 3, "equipment"),
    ("widget", 1, 1, "gadget"), ("widget", 1, 2, "doohickey"), ("widget", 2, 1, "control"),
    ("anvil", 1, 1, "block"), ("anvil", 2, 1, "incus"), ("plate", 1, 1, "disk"), ("plate", 1, 2, "ring"),
    ("plate", 2, 1, "sheet"), ("plate", 3, 1, "dish"), ("blue", 1, 1, "azure"), ("blue", 2, 1, "cold"),
    ("cold", 1, 1, "chilly"), ("cold", 1, 2, "frigid"), ("large", 1, 1, "big"), ("large", 1, 2, "bulky"),
    ("small", 1, 1, "little"), ("small", 1, 2, "minor"), ("economy", 1, 1, "thrift"),
    ("economy", 1, 2, "saving"), ("standard", 1, 1, "criterion"), ("standard", 2, 1, "banner"),
    ("medium", 1, 1, "average"), ("promo", 1, 1, "promotion"), ("brand", 1, 1, "make"),
    ("brand", 1, 2, "trade_name"), ("brand", 2, 1, "mark"),
]
LEMMAS = [
    ("rings", "ring"), ("nations", "nation"), ("customers", "customer"), ("tionhan", "tion"),
    ("eran", "era"), ("esen", "ese"), ("thnt", "tht"), ("inan", "ina"), ("erth", "er"),
]
EXCEPTIONS = [
    ("inan", 1, "erthin"), ("inan", 2, "inin"), ("erth", 1, "er"), ("erth", 2, "ered"), ("anshes", 1, "erth"),
    ("ansh", 1, "nowhere"), ("tionhan", 1, "ion"), ("tionhan", 2, "ingat"), ("thnt", 1, "thst"), ("esen", 1, "eses"),
]
EVENT_USERS = ["north", "south", "east", "west", "centre"]
TRIALS = [
    (1, 3, 0.05, 0.60, 0.25, 0.15),
    (2, 5, 0.08, 0.50, 0.25, 0.25),
    (3, 1, 0.30, 0.20, 0.40, 0.40),
    (4, 10, 0.01, 0.34, 0.33, 0.33),
    (5, 2, 0.15, 0.10, 0.80, 0.10),
]


def table(spark: SparkSession, sf: str, name: str, key: str = None) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df if key is None else widen(df, key)


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents", "doc_id").select(
        F.col("doc_id").alias("company_id"), F.col("text").alias("description"),
        F.col("lang").alias("sector"), F.col("source").alias("category"),
    )


def tailed(spark, sf) -> DataFrame:
    """Documents with a literal tail, by key."""
    tails = F.array(*map(F.lit, TAILS))
    pick = (F.col("company_id") % len(TAILS)).cast("int")
    docs = documents(spark, sf)
    return docs.withColumn("description", F.concat("description", F.get(tails, pick)))


def benchmark(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("label_id"), F.col("text").alias("label"),
        T.clean_text(F.col("text")).alias("cleaned_label"),
    )


def cleaned_documents(spark, sf) -> DataFrame:
    return documents(spark, sf).select(
        "company_id", T.clean_text(F.col("description")).alias("combined_features")
    )


def turns(spark, sf) -> DataFrame:
    """Conversation turns as companies of medium length."""
    return table(spark, sf, "conversations", "conv_id").select(
        F.concat_ws("-", "conv_id", "turn").alias("company_id"),
        T.clean_text(F.col("text")).alias("combined_features"),
    )


def parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part", "p_partkey").select(
        F.col("p_partkey").alias("company_id"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.col("p_type").alias("business_tags"),
        F.col("p_brand").alias("category"),
    )


def part_texts(spark, sf) -> DataFrame:
    """One short cleaned text per part."""
    return parts(spark, sf).select(
        "company_id", T.clean_text(F.concat_ws(" ", "description", "category")).alias("combined_features")
    )


def part_labels(spark, sf) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_name").alias("label")).distinct()
    return with_label_id(names, order_by="label").withColumn(
        "cleaned_label", T.clean_text(F.col("label"))
    )


def customers(spark, sf) -> DataFrame:
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf, "customer", "c_custkey").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


def synonyms(spark) -> DataFrame:
    return spark.createDataFrame(SYNONYMS, "term string, synset_rank int, lemma_rank int, lemma string")


def lemmas(spark) -> DataFrame:
    return spark.createDataFrame(LEMMAS, "surface string, lemma string")


def event_texts(spark, sf) -> DataFrame:
    """Every event as a short text: its type, a word for its value, one for its user."""
    size = F.when(F.col("value") < 5, "tiny").when(F.col("value") < 20, "middling").otherwise("huge")
    who = F.get(F.array(*map(F.lit, EVENT_USERS)), (F.col("user_id") % len(EVENT_USERS)).cast("int"))
    return table(spark, sf, "events", "event_id").select(
        F.col("event_id").alias("company_id"), F.concat_ws(" ", "event_type", size, who).alias("combined_features"), "ts"
    )


def event_labels(spark, sf) -> DataFrame:
    names = event_texts(spark, sf).select(
        F.substring_index("combined_features", " ", 2).alias("label")
    ).distinct()
    return with_label_id(names, order_by="label").withColumn("cleaned_label", F.col("label"))


def lemma_rules(spark, sf) -> LemmaRules:
    """Known lemmas: the words of the benchmark; irregular forms: a short list."""
    index = benchmark(spark, sf).select(F.explode(A.words(F.col("cleaned_label"))).alias("lemma"))
    exceptions = spark.createDataFrame(EXCEPTIONS, "surface string, rank int, lemma string")
    return LemmaRules(index, exceptions)


def write_lexicon(spark, sf, folder: str) -> None:
    """A lexicon in the public text layout: every part is a synset of the words of
    its name, type and brand, every word a term, nouns and verbs by part number."""
    part = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 3 == 0, "verb").otherwise("noun").alias("pos"),
        F.format_string("%08d", "p_partkey").alias("offset"),
        F.array(F.replace("p_name", F.lit(" "), F.lit("_")), F.concat("p_type", F.lit("(p)")), F.col("p_brand")).alias("words"),
    )
    number = F.lower(F.lpad(F.hex(F.size("words")), 2, "0"))
    synset = F.concat_ws(" ", "offset", F.lit("03 n"), number, F.array_join(F.transform("words", lambda w: F.concat(w, F.lit(" 0"))), " "), F.lit("000 | a gloss"))
    term = F.explode(F.transform("words", lambda w: F.lower(F.regexp_replace(w, r"\(.*", ""))))
    terms = part.select("pos", "offset", term.alias("term")).groupBy("pos", "term").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))
    line = F.concat_ws(" ", "term", F.substring("pos", 1, 1), F.size("offsets"), F.lit("2 @ ~"), F.size("offsets"), F.lit("0"), F.array_join("offsets", " "))
    licence = spark.createDataFrame([("  1 A licence of several lines.  ",)], "value string")
    for pos in ("noun", "verb"):
        for kind, rows, text in (("data", part, synset), ("index", terms, line)):
            rows.where(F.col("pos") == pos).select(text.alias("value")).unionAll(licence).write.text(f"{folder}/{kind}.{pos}")


def trials(spark) -> DataFrame:
    from labelloom.operators.tuning import TRIAL_SCHEMA

    return spark.createDataFrame(TRIALS, TRIAL_SCHEMA)


def classified(spark, sf, extra: list[str] = ()) -> DataFrame:
    """Customers classified by their order priorities: the labels are the
    priorities a customer uses, most used first, the score is the share of the
    customer's orders."""
    counts = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("company_id")
    matches = counts.select(
        "company_id", "label",
        (F.col("n") / F.sum("n").over(own)).alias("score"),
        F.row_number().over(own.orderBy(F.desc("n"), "label")).alias("rank"),
    )
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), *extra)
    return ranking.with_label_text(
        base.join(ranking.label_lists(matches, ["company_id"]), "company_id", "left")
    )
