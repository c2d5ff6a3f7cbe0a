from pyspark.sql import functions as F

from labelloom.functions import arrays as A
from labelloom.functions import text as T
from labelloom.operators import features


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(expr(F.col("c")).alias("r")).first()["r"]


def test_legal_suffix(spark):
    name = "The Company Corporation Incorporated SAP Co."
    assert one(spark, name, T.strip_legal_suffix) == "The mpany oration orporated P "
    whole = one(spark, "Acme Corporation Inc. SAP", lambda c: T.clean_company_name(c, True))
    assert whole == "Acme Sap"
    assert one(spark, None, T.clean_company_name) is None


def test_title_case(spark):
    assert one(spark, "o'neil's abc-def 3m a_b", T.title_case) == "O'Neil'S Abc-Def 3M A_B"


def test_normalize_terms(spark):
    assert one(spark, "P&C and WC cover", T.normalize_terms) == (
        "property and casualty and workers compensation cover"
    )
    assert one(spark, "Cyber-security", T.normalize_terms) == "cybersecurity insurance-security"
    assert one(spark, None, T.normalize_terms) == ""
    assert one(spark, "piano pié wcx", T.normalize_terms) == "piano pié wcx"


def test_clean_text(spark):
    text = "We sell e-commerce, third-party GL policies!"
    assert one(spark, text, T.clean_text) == "sell e commerce third party general liability"
    observed = one(spark, text, lambda c: T.clean_text(c, phrases="observed"))
    assert observed == "sell term placeholder TERM PLACEHOLDER general liability"
    assert one(spark, None, T.clean_text) == ""
    assert one(spark, "the and of", T.clean_text) == ""
    assert one(spark, "see http://a.b/c?d or mail a.b@c-d.org café", T.clean_text) == "see mail caf"


def test_ngrams(spark):
    def grams(value, n):
        df = spark.createDataFrame([(value,)], "c string").select(A.words(F.col("c")).alias("w"))
        return df.select(A.ngrams(F.col("w"), n).alias("r")).first()["r"]

    assert grams("a b c", 2) == ["a b", "b c"]
    assert grams("a", 2) == [] and grams("", 2) == [] and grams("a b", 3) == []


def test_key_terms(spark):
    df = spark.createDataFrame([("tree service pruning",), ("a tree of life",)], "c string")
    got = [r["key_terms"] for r in features.with_key_terms(df, "c").collect()]
    assert got[0] == ["tree", "service", "pruning", "tree service", "service pruning"]
    assert got[1] == ["tree", "life"]
    basic = features.with_key_terms(df, "c", "basic").collect()[1]["key_terms"]
    assert basic == ["tree", "life", "a tree", "tree of", "of life", "a tree of", "tree of life"]


def test_expand_labels(spark):
    df = spark.createDataFrame([("Real Estate Services",), ("x",)], "label string")
    got = [r["expanded_terms"] for r in features.expand_labels(df).collect()]
    assert got[0] == (
        "property realty housing buildings land "
        "Real Estate Real Estate Services Estate Services"
    )
    assert got[1] == ""


def test_label_cells(spark):
    def labels(cell):
        return one(spark, cell, A.label_list)

    assert labels("['Tree Services', \"Children's Clothing Manufacturing\"]") == [
        "Tree Services", "Children's Clothing Manufacturing",
    ]
    assert labels("['it\\'s \"x\"']") == ["it's \"x\""]
    assert labels("Unclassified") == [] and labels(None) == [] and labels("[]") == []
    assert labels("[broken") == ["[broken"]
    assert labels("a, b") == ["a", "b"]
    assert one(spark, "[0.5, 1]", A.score_list) == [0.5, 1.0]


def test_lemmatize(spark):
    df = spark.createDataFrame([(1, "dogs and cats", "dogs"), (2, "", None)], "id int, a string, b string")
    lemmas = spark.createDataFrame([("dogs", "dog"), ("cats", "cat")], "surface string, lemma string")
    got = {r["id"]: (r["a"], r["b"]) for r in features.lemmatize(df, "id", ["a", "b"], lemmas).collect()}
    assert got == {1: ("dog and cat", "dog"), 2: ("", "")}


def test_lowered_text_has_the_same_long_forms(spark):
    texts = ["P&C, pi_x Pi wc. WC$ gl", "cyber\\1 Cyber CYBER cyberx xcyber 9pi pi9 d&o a&h&d&o", "pı PI İ pİ ul", "ſ&c PI", None, "", "b2B.b2c_ b2c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for terms in (None, {"Wc": "P&C of $1\\x", "p&c": "wc", "x": ""}, {}, {"ſ": "s", "pi": "ul"}):
        plain, fast = F.lower(T.normalize_terms(F.col("text"), terms)), T.lower_normalized(F.col("text"), terms)
        for r in df.select(plain.alias("a"), fast.alias("b")).collect():
            assert r["a"] == r["b"]
