"""PII, quality rules, chat formatting, licences and sharding."""

import re
import string
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.llm import chat, licenses, pii, quality, sharding
from tests.llm.common import TEXTS, edge_docs, no_docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(c) for c in digits[::-1]]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(odd)) % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            ):
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def test_pii_base_equals_plain_regular_expressions(spark):
    rows = pii.find(edge_docs(spark)).collect()
    want = sorted(str((i, base_spans(t))) for i, t in TEXTS)
    got = sorted(
        str((r["doc_id"], [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"] if s["rank"] < 4])) for r in rows
    )
    assert got == want


def test_pii_checksums_and_context(spark):
    rows = {r["doc_id"]: [(s["kind"], s["text"]) for s in r["spans"]] for r in pii.find(edge_docs(spark)).collect()}
    assert ("iban", "DE89 3704 0044 0532 0130 00") in rows[8]
    assert [x for x in rows[8] if x[0] == "ssn"] == [("ssn", "078-05-1120")]  # only the one with a hint
    assert ("secret", "0123456789abcdef0123456789abcdef") in rows[1]
    assert [x for x in rows[7] if x[0] == "card"] == [("card", "4111 1111 1111 1111")]


def test_pii_redaction(spark):
    docs = edge_docs(spark).where("doc_id = 1").withColumn("spans", pii.spans(F.col("text")))
    out = docs.select(pii.redact(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    assert out == "Mail me: [email] or [phone].\nToken = [secret]"


def test_pii_empty(spark):
    assert pii.find(no_docs(spark)).count() == 0


def counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)
    )


def test_quality_statistics(spark):
    rows = edge_docs(spark).select("doc_id", quality.statistics(F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    got = sorted(str((r["doc_id"], tuple(r[1:6]))) for r in rows)
    assert got == sorted(str((i, counts(t))) for i, t in TEXTS)


def labelled(spark, n=600):
    """Every third text is full of marks, every fifth in capitals."""
    def text(i):
        body = [f"w{(i * 7 + j) % 97} word{j}" for j in range(20)]
        if i % 3 == 0:
            return "### ".join(body)
        return (" ".join(body)).upper() if i % 5 == 0 else " ".join(body)

    rows = [(i, text(i), int(i % 3 != 0 and i % 5 != 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_rules_are_learned(spark):
    data = labelled(spark).select("doc_id", "quality", quality.statistics(F.col("text")).alias("s"))
    rules = quality.fit(data)
    kept = {r["doc_id"]: r["k"] for r in data.select("doc_id", rules.kept(F.col("s")).alias("k")).collect()}
    assert kept == {i: i % 3 != 0 and i % 5 != 0 for i in range(600)}
    assert str(rules).endswith("otherwise keep") and len(rules.rules) == 2


def test_statistics_of_marks_blanks_and_repeated_windows(spark):
    texts = ["A&&b \\ [x] ^-] #1|2 <T> Ä! \U0001f600\x85\xa0z", "\x0b \n \x0c\nx\n\x85\n", "a b c d e f", "a b c d e " * 3, "q a a a a a a a", None, ""]

    def brute(text):
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 5 else {}
        covered = {i + j for i in range(len(w) - 4) for j in range(5) if n and n[tuple(w[i : i + 5])] > 1}
        chars = "".join(w)
        kinds = [sum(c in k for c in chars) for k in (quality.SYMBOLS, string.ascii_uppercase, string.digits, ".,;:!?", "!")]
        return [len(w), len(chars), kinds[0], len(lines) - len(set(lines)), len(covered), len(set(w)), *[k / max(len(chars), 1) for k in kinds[1:4]], kinds[4] / max(len(w), 1)]

    s = quality.statistics(F.col("text"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", s.alias("s")).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "distinct_words", "capitals", "digits", "punctuation", "exclamations"]
    for r in rows:
        want = brute(texts[r["i"]])
        want[5] /= max(want[0], 1)
        assert [r["s"][k] for k in names] == pytest.approx(want), texts[r["i"]]


def test_statistics_look_up_only_the_few_counted_characters(spark):
    """A translation looks up every character of its text, so none takes a whole one."""
    plan = spark.createDataFrame([("a",)], "text string").select(quality.statistics(F.col("text")))
    plan = plan._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace(coalesce(text" in plan and "translate(coalesce(text" not in plan


def test_quality_without_labels(spark):
    data = quality.with_labels(edge_docs(spark), spark.createDataFrame([], "doc_id long, quality int"))
    rules = quality.fit(data)
    assert rules.rules == []
    kept = edge_docs(spark).where(rules.kept(quality.statistics(F.col("text")))).select("doc_id").collect()
    assert {r[0] for r in kept} == {None, 1, 2, 7, 8} | {i for i, t in TEXTS if i and counts(t)[0] >= 10 and 100 * counts(t)[4] <= 20 * counts(t)[0]}


def test_chat_common_prefix_is_rendered_once(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "good"), (2, 2, "user", "other"), (2, 2, "user", "other"),
        (3, 0, "user", "alone"), (3, 1, "assistant", "abcdef"), (4, 0, "user", "no reply"),
        (None, 0, "user", "x"), (5, None, "user", "x"), (6, 0, None, None),
    ]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    out = chat.format_pairs(*chat.shared_start_pairs(talk)).collect()
    got = {(r["pair_id"], r["part"], r["turn"], r["content"], r["mask"]) for r in out}
    assert got == {
        (2, "prompt", 0, "<|user|>\nhi\n", 0),
        (2, "prompt", 1, "<|assistant|>\ngood\n", 0),
        (2, "chosen", 2, "<|user|>\nmore\n", 0),
        (2, "chosen", 3, "<|assistant|>\nyes\n", 1),
        (2, "rejected", 2, "<|user|>\nother\n", 0),
        (3, "prompt", 0, "<|user|>\nalone\n", 0),
        (3, "chosen", 1, "<|assistant|>\nabcdef\n", 1),
        (3, "rejected", 1, "<|assistant|>\nabc\n", 1),
    }
    assert chat.format_pairs(*chat.shared_start_pairs(talk.where("false"))).count() == 0


def test_licenses(spark):
    known = licenses.known_digests(licenses.builtin_texts(spark))
    got = {(r["doc_id"], r["line"], r["license"]) for r in licenses.scan(edge_docs(spark), known).collect()}
    assert got == {(12, 1, "MIT"), (13, -1, "Apache-2.0")}
    text = "Copyright (c) 2021 Somebody\n\n" + licenses.TEXTS[0][1].upper().replace("  ", " ").replace("COPY", "Copy")
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["line"], r["license"]) for r in licenses.scan(docs, known).collect()] == [(1, -1, "MIT")]


def test_whole_licenses_in_any_wrapping_and_with_a_title(spark):
    known = licenses.known_digests(licenses.builtin_texts(spark))
    texts, want = [], []
    for name, text in licenses.TEXTS:
        title = dict(licenses.NAMES)[name][0]
        flat = " ".join(text.split())
        for body in (text, flat, textwrap.fill(flat, 40), textwrap.fill(flat, 78)):
            for head in ("", f"{title}\n\n", f"{title}\n\nCopyright (c) 2020 Jo Doe\n", "Copyright 2020 Jo Doe "):
                texts.append((len(texts), head + body))
                want.append((len(want), name))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = licenses.scan(docs, known).where("line = -1").collect()
    assert sorted((r["doc_id"], r["license"]) for r in rows) == want


def check_rows_law(rows, shards=sharding.SHARDS):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_keeps_equal_texts_together(spark):
    texts = [f"text {i}" for i in range(500)] + [f"pair {i % 60}" for i in range(180)] + ["hot"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("shard", F.lit(1))
    rows = sharding.assign(docs).collect()
    assert len(rows) == len(texts)
    check_rows_law(rows)
    where = {}
    for r in rows:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(v) > 1 for k, v in where.items() if k.startswith("pair")) <= 3
    assert len(where["hot"]) <= 14  # it needs 8 of the 24 shards


@pytest.mark.parametrize("make", [edge_docs, no_docs])
def test_sharding_edges(spark, make):
    docs = make(spark)
    rows = sharding.assign(docs).collect()
    assert len(rows) == docs.count()
    check_rows_law(rows)
