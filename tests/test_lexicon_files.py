"""Noun rules and the scan of lexicon files."""

import random

import pytest

from labelloom.operators import lemmas
from labelloom.operators.features import clean_columns
from labelloom.operators.lemmas import NOUN_ENDINGS, LemmaRules
from labelloom.sources import lexicon_files


def plain_lemma(form, index, exceptions):
    def known(forms):
        return [f for f in forms if f in index]

    def detach(forms):
        return [f[: len(f) - len(e)] + n for f in forms for e, n in NOUN_ENDINGS if f.endswith(e)]

    if form in exceptions:
        found = known([form, *exceptions[form]])
    else:
        forms = detach([form])
        found = known([form, *forms])
        while forms and not found:
            forms = detach(forms)
            found = known(forms)
    return min(found, key=len) if found else form


def rules(spark, index, exceptions):
    listed = [(s, i, f) for s, fs in exceptions.items() for i, f in enumerate(fs)]
    return LemmaRules(
        spark.createDataFrame([(x,) for x in index], "lemma string"),
        spark.createDataFrame(listed, "surface string, rank int, lemma string") if listed else None,
    )


@pytest.mark.parametrize("seed", range(3))
def test_lemmas_equal_the_plain_rules(spark, seed):
    rng = random.Random(seed)
    parts = ["s", "ses", "ves", "xes", "zes", "ches", "shes", "men", "ies", "a", "b", "c", "wol", "man", "sss"]
    forms = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(400)} | {"ssssss", "s"}
    index = {f[: rng.randint(1, len(f))] for f in rng.sample(sorted(forms), 250)} | {"wolf", "wolve"}
    exceptions = {f: rng.sample(sorted(index), 2) + ["unknown"] for f in rng.sample(sorted(forms), 20)} if seed else {}
    df = spark.createDataFrame([(f,) for f in sorted(forms)], "surface string")
    got = {r["surface"]: r["lemma"] for r in lemmas.noun_lemmas(df, rules(spark, sorted(index), exceptions)).collect()}
    assert got == {f: w for f in forms if (w := plain_lemma(f, index, exceptions)) != f}
    assert got["wolves"] == "wolf" if "wolves" in forms else True


def test_cleaning_with_rules(spark):
    df = spark.createDataFrame([(1, "Churches and boxes of the mice"), (2, None)], "company_id long, description string")
    known = rules(spark, ["church", "box", "mouse", "boxe"], {"mice": ["mouse"]})
    out = clean_columns(df, {"description": "cleaned"}, "company_id", known)
    assert {r["company_id"]: r["cleaned"] for r in out.collect()} == {1: "church box mouse", 2: ""}


def test_lexicon_files(spark, tmp_path):
    files = {
        "index.noun": "  1 licence text\nring n 2 1 @ 2 0 00000010 00000030  \nbell_ringer n 1 1 @ 1 0 00000030\n",
        "data.noun": "  1 licence text\n00000010 04 n 02 ring 0 band 1 001 @ 00000001 n 0000 | a circle\n"
                     "00000030 04 n 0a ring 0 b 0 c 0 d 0 e 0 f 0 g 0 h 0 bell_ringer 0 Tolling 2 000 | more\n",
        "index.adj": "ring a 1 0 1 0 00000010\n",
        "data.adj": "00000010 00 s 02 annular(a) 0 ringed(ip) 0 000 | adjective\n",
        "noun.exc": "men man\naxes ax axis\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = sorted(map(tuple, lexicon_files.read_synsets(spark, str(tmp_path)).collect()))
    long = ["ring", "b", "c", "d", "e", "f", "g", "h", "bell_ringer", "Tolling"]
    want = [("ring", 1, 1, "ring"), ("ring", 1, 2, "band"), ("ring", 3, 1, "annular"), ("ring", 3, 2, "ringed")]
    want += [("ring", 2, i + 1, w) for i, w in enumerate(long)] + [("bell ringer", 1, i + 1, w) for i, w in enumerate(long)]
    assert got == sorted(want)
    known = lexicon_files.read_lemma_rules(spark, str(tmp_path))
    assert {r["lemma"] for r in known.index.collect()} == {"ring", "bell_ringer"}
    assert sorted(map(tuple, known.exceptions.collect())) == [("axes", 0, "ax"), ("axes", 1, "axis"), ("men", 0, "man")]
    with pytest.raises(FileNotFoundError):
        lexicon_files.read_synsets(spark, str(tmp_path / "nothing"))
