"""Language model, packing and decontamination against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelloom.llm import decontamination, lm, packing
from labelloom.llm.queries import tokenizer_path
from tests.llm.common import SF, TEXTS, edge_docs, no_docs


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def base_scores(texts):
    counts = Counter(w for i, t in texts if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, [
        (i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)),
         sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)))
        for i, t in texts
    ]


def check_base(rows, texts):
    n, want = base_scores(texts)
    got = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in rows))
    want = sorted((str(i), *x) for i, *x in want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-9)
    assert {r["train_tokens"] for r in rows} <= {n}


def test_base_scores_on_edges(spark):
    rows = lm.score(edge_docs(spark)).collect()
    check_base(rows, TEXTS)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows)
    assert lm.score(no_docs(spark)).count() == 0


def test_held_out_texts_gain_from_bigrams_and_blocks_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = lm.score(docs).collect()
    check_base(rows, texts)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    monkeypatch.setattr(lm, "BLOCK_SLICES", 1)
    monkeypatch.setattr(lm, "BITS", 200)
    one = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "BLOCK_SLICES", 512)
    assert {r["doc_id"]: r["score"] for r in lm.score(docs).collect()} == pytest.approx(one, rel=1e-9)


def test_bigrams_of_rare_words_are_in_the_model(spark):
    """Pairs of words that are far below 1/CLASSES of the tokens, always met
    together, score higher than the same words met in another order."""
    rng = random.Random(3)
    fill = [f"f{i}" for i in range(9000)]
    pairs = [(f"a{i}", f"b{i}") for i in range(600)]
    texts = []
    for i in range(600):
        words = rng.choices(fill, k=60)
        for p in rng.sample(pairs, 6):
            at = rng.randrange(len(words))
            words[at:at] = p
        texts.append((i, " ".join(words)))
    free = [i for i in range(600, 2000) if held(i)]
    met = " ".join(f"{a} {b}" for a, b in pairs)
    other = " ".join(f"{a} {pairs[i - 1][1]}" for i, (a, _) in enumerate(pairs))
    texts += [(free[0], met), (free[1], other)]
    rows = lm.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check_base(rows, texts)
    got = {r["doc_id"]: r["score"] for r in rows}
    assert got[free[0]] > got[free[1]] + 40
    n = Counter(w for i, t in texts if not held(i) for w in tokens(t))
    assert all(n[w] * lm.CLASSES < sum(n.values()) for w in n if w != b"\n")


def test_weights_are_fitted_on_the_tokens_of_all_parts(spark, monkeypatch):
    """However many parts the tokens are dealt into, all training tokens fit the
    weights: only those between words with classes of their own need no fit."""
    rng = random.Random(5)
    often, rare = [f"o{i}" for i in range(20)], [f"r{i}" for i in range(3000)]
    texts = [(i, " ".join(rng.choices(often, k=60) + rng.choices(rare, k=120))) for i in range(60)]
    texts += [(None, "o1 " * 400 + "r1 " * 400), (71, None), (72, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)
    gains = lm._gains

    def counted(model, pairs, table):
        seen.add(int(lm.Part(model, pairs, table.filter(table["before"].is_valid())).training.sum()))
        return gains(model, pairs, table)

    monkeypatch.setattr(lm, "_gains", counted)
    whole = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(docs).collect()}
    n = Counter(w for i, t in texts if not held(i) for w in tokens(t))
    own = {w for w in n if n[w] * lm.CLASSES > sum(n.values())}
    pairs = [p for i, t in texts if not held(i) for p in zip([b"\n", *tokens(t)], tokens(t))]
    wanted = sum(not (a in own and b in own) for a, b in pairs)
    assert seen.value == wanted
    seen.value = 0
    monkeypatch.setattr(lm, "PART_TOKENS", 300)
    rows = lm.score(docs).collect()
    check_base(rows, texts)
    assert seen.value == wanted
    assert {(r["doc_id"], r["n_tokens"]): r["score"] for r in rows} == pytest.approx(whole, rel=0.02)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 2**64 - 1), st.integers(1, 10**6), min_size=1, max_size=200))
def test_filter_never_underestimates(counts):
    keys, n = np.array(list(counts), "uint64"), np.array(list(counts.values()))
    at = lm.slice_of(keys, 3)
    parts = [lm.fill(keys[at == s], lm.level(n[at == s])) for s in range(3)]
    read = lm.CountFilter(3, 0, parts).counts(keys)
    assert (read >= lm.count_of(lm.level(n)) - 1e-9).all()
    assert (read <= 1.6 * np.maximum(n, 2)).mean() > 0.9


def test_levels_stand_for_counts():
    n = np.arange(1, 5000)
    ratio = lm.count_of(lm.level(n)) / n
    assert lm.count_of(np.array([0]))[0] == 0 and ratio[:3] == pytest.approx(1) and (abs(np.log(ratio)) < 0.25).all()


def check_packing(rows, texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4") for _, t in texts]
    want = sorted(
        (str(i), at, len(x[at : at + 4096]), zlib.crc32(x[at : at + 4096].tobytes()), len(x))
        for (i, _), x in zip(texts, ids, strict=True)
        for at in range(0, len(x), 4096)
    )
    assert sorted((str(r[0]), *r[1:5]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        assert sum(n for _, n in parts) <= 4096
    return len(sequences)


def test_packing_on_edges(spark):
    odd = [(50, "a<|endoftext|>B <|ENDOFTEXT|> it's 12ab …"), (51, "É ΟΔΟΣ. İstanbul á x\x1cy z ab''s !?'ll"), (52, "w " * 9000)]
    texts = TEXTS + odd
    docs = edge_docs(spark).select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    check_packing(packing.pack(docs.withColumn("part", F.lit(1)), tokenizer_path()).collect(), texts)
    assert packing.pack(no_docs(spark), tokenizer_path()).count() == 0


def test_packing_fills_sequences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = packing.pack(docs, tokenizer_path()).collect()
    n = check_packing(rows, texts)
    assert sum(r["length"] for r in rows) > 0.95 * 4096 * (n - 1)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_hold_every_length_once(counts):
    patterns = packing.pack_histogram(counts, 64)
    seen = Counter()
    for pattern, n in patterns:
        assert sum(k * v for k, v in pattern.items()) <= 64
        for k, v in pattern.items():
            seen[k] += v * n
    assert seen == Counter(counts)


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.5:
            words[at] = f"zz{rng.randrange(1000)}"
        elif kind < 0.75:
            del words[at]
        else:
            words.insert(at, f"zz{rng.randrange(1000)}")
    return words


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(4)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs, want = [], set()
    for n, (item, text) in enumerate(items * 3):
        words = decontamination.word_list(text)
        fill = [f"f{rng.randrange(50)}" for _ in range(80)]
        body = [w.decode() for w in words]
        docs.append((n, " ".join(fill + edited(body, decontamination.allowed(len(words)) * (n // len(items)) // 2, rng) + fill)))
        block = decontamination.Block([text])
        ids = np.array([block.vocabulary.get(w, 0) for w in decontamination.word_list(docs[-1][1])])
        assert decontamination.distance(block.items[0], ids)[0] <= decontamination.allowed(len(words))
        want.add((n, item))
    docs.append((999, "nothing of the sort " * 30))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(table, bench).collect()}
    assert len(want & got) >= 0.95 * len(want) and all(d != 999 for d, _ in got)
    clean = decontamination.decontaminate(table, bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_decontamination_edges(spark):
    docs = edge_docs(spark)
    bench = spark.createDataFrame([(1, TEXTS[0][1]), (2, TEXTS[0][1]), (3, None), (4, ""), (5, "too short here")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.find_leaks(docs, bench).collect())
    assert got == [(1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 2, 0)]
    assert decontamination.decontaminate(docs, bench).count() == len(TEXTS) - 2
    assert decontamination.find_leaks(docs, bench.where("false")).count() == 0
    assert decontamination.find_leaks(no_docs(spark), bench).count() == 0
    assert decontamination.decontaminate(docs, bench.where("false")).count() == len(TEXTS)


def test_distance_to_a_part():
    assert decontamination.distance(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 4, 9])) == (1, 4)
    assert decontamination.distance(np.array([1, 2]), np.array([], "int64")) == (2, 0)


def test_one_very_long_item_among_many_short_ones():
    import tracemalloc

    rng = random.Random(8)
    pool = [f"w{i}" for i in range(3000)]
    short = [" ".join(rng.choices(pool, k=rng.randint(5, 12))) for _ in range(10_000)]
    long = " ".join(rng.choices(pool, k=20_000))
    tracemalloc.start()
    block = decontamination.Block([*short, long])
    middle = long.split()
    for at in rng.sample(range(20_000), 300):
        middle[at] = "other"
    texts = [f"before {short[17]} after", " ".join(["x"] * 50 + middle + ["y"] * 50), " ".join(rng.choices(pool, k=500)), None]
    found = {(row, key) for row, key, _, _ in block.leaks(texts)}
    assert tracemalloc.get_traced_memory()[1] < 600 << 20
    tracemalloc.stop()
    assert {(0, 17), (1, 10_000)} <= found and not {r for r, _ in found} & {3}


def test_windows_sign_alike_in_rows_of_any_width():
    block = decontamination.Block(["a b c d e f g", " ".join(f"w{i}" for i in range(40))])
    item = block.items[0][None, :]
    wide = np.concatenate([item, np.full((1, 30), 9)], axis=1)
    lengths = np.array([7])
    assert [k.tolist() for k in block._signatures(item, lengths)] == [k.tolist() for k in block._signatures(wide, lengths)]
