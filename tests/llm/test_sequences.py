"""Periodic runs, conversation repair and document fingerprints against brute force."""

import hashlib
import random
import sys
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from labelloom.llm import fingerprints, queries, repair, runs
from tests.llm.common import SF, TEXTS, edge_docs, no_docs

sys.setrecursionlimit(20_000)  # the plain search goes one call deeper per turn
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w]


# ---- periodic runs


def plain_runs(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(least, 2 * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


@pytest.mark.parametrize("length", [1, 2, 8, 256, 2048])
def test_squared_differences_are_exact(length):
    rng = np.random.default_rng(length)
    blocks = rng.integers(1, runs.PRIME, (3, length)).astype("uint64")
    windows = rng.integers(1, runs.PRIME, (3, 3 * length - 1)).astype("uint64")
    windows[1, length // 2 : length // 2 + length] = blocks[1]
    found = runs.mismatches(blocks, windows)
    for row in range(3):
        for at in (0, length // 2, 2 * length - 1):
            both = zip(blocks[row].tolist(), windows[row, at : at + length].tolist())
            assert found[row, at] == sum((a - b) ** 2 for a, b in both) % runs.PRIME
    assert found[1, length // 2] == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5), st.integers(0, 90), st.integers(0, 10**6), st.sampled_from([2, 3, 12]))
def test_runs_equal_brute_force(letters, n, seed, least):
    rng = random.Random(seed)
    words = [rng.randint(1, letters) for _ in range(n)]
    if n and seed % 2:
        start = rng.randrange(n)
        period = 1 + (n - start) // rng.randint(3, 10)
        words = [w if i < start else words[start + (i - start) % period] for i, w in enumerate(words)]
    assert runs.runs_of(np.array(words, "int64"), least) == plain_runs(words, least)


def test_long_texts():
    one, cycle = np.ones(30_000, "int64"), np.arange(30_000) % 3001 + 1
    assert runs.runs_of(one) == [(0, 30_000, 1)]
    assert runs.runs_of(cycle) == [(0, 30_000, 3001)]
    joined = np.concatenate([np.arange(5000) + 9000, cycle[:7000], one[:40]])
    assert runs.runs_of(joined) == [(5000, 7000, 3001), (11_999 if joined[11_999] == 1 else 12_000, 40, 1)]


def test_equal_sums_of_different_words_are_no_run(monkeypatch):
    monkeypatch.setattr(runs, "mismatches", lambda b, w: np.zeros((len(b), 2 * b.shape[1]), "uint64"))
    words = [1, 2, 1, 2, 2, 1] * 4
    assert runs.runs_of(np.array(words)) == plain_runs(words)


def edited_words(doc_id, text):
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_op11(doc_id, text):
    words = edited_words(doc_id, text)
    found = plain_runs(words) if len(words) < 3000 else runs.runs_of(np.unique(words, return_inverse=True)[1] + 1)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(" ".join(kept)))


def test_op11_on_edges(spark, tmp_path):
    more = [(10 + i, "a b c " * 9 + "x " + "word " * n) for i, n in enumerate((0, 11, 12, 13, 300))]
    docs = edge_docs(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain_op11(i, t) for i, t in [*TEXTS, *more]), key=str)
    assert runs.periodic_runs(no_docs(spark)).collect() == []


# ---- conversation repair


def plain_edits(letters):
    """Least (cost, audit) by trying every edit at every place."""

    @lru_cache(None)
    def best(i, state, inserted):
        out = [(0, "")] if i == len(letters) and state in (0, 3) else []
        after = 3 if state == 2 else 2

        def then(cost, edit, *place):
            if (rest := best(*place)) is not None:
                out.append((cost + rest[0], edit + rest[1]))

        if inserted < 3:
            then(5, "I", i, after, inserted + 1)
        if i < len(letters):
            kind, fault = divmod(ord(letters[i]) - ord("A"), 3)
            late = 5 if fault == 2 else 0
            then(2, "D", i + 1, state, 0)
            if fault != 1:
                then(1 + late, "R", i + 1, after, 0)
                kept = {0: 1 if state == 0 else None, 1: 2 if state != 2 else None, 2: 3 if state == 2 else None, 3: None}[kind]
                if kept:
                    then(late, "K", i + 1, kept, 0)
        return min(out, default=None)

    return best(0, 0, 0)


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["ABCDEFGHIJKL", "DG", "DGAF", "DDGGFIE", "FI"]), st.integers(1, 14), st.integers(0, 10**6))
def test_edits_equal_brute_force(pool, n, seed):
    rng = random.Random(seed)
    letters = "".join(rng.choice(pool) for _ in range(n))
    assert "".join(repair.edits(letters)) == plain_edits(letters)[1]
    cuts = sorted(rng.sample(range(1, n), min(n - 1, 3)))
    parts = [letters[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
    states = repair.crossings([repair.product(p) for p in parts], 0, None)
    ends = [*states[1:-1], None]
    assert "".join("".join(repair.edits(p, a, b)) for p, a, b in zip(parts, states, ends)) == plain_edits(letters)[1]


def plain_repair(conv, rows):
    """rows: (turn, role, text) of one conversation -> its row of op12."""
    after = []
    for turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, letters, faults = set(), "", [0, 0, 0]
    for _, role, text in after:
        inked = text.rstrip(SPACE)
        fault = 1 if not inked else 2 if (role, text) in seen else 3 if inked[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            faults[fault - 1] += 1
        initial = "sua".find(role[:1]) if role else -1
        letters += chr(ord("A") + 3 * (initial if initial >= 0 else 3) + {0: 0, 1: 1, 2: 1, 3: 2}[fault])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:])]
    turns = [r[0] for r in after if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = plain_edits(letters)
    out, i, state = [], 0, 0
    for edit in audit:
        if edit in "IR":
            state = 3 if state == 2 else 2
            role = "assistant" if state == 3 else "user"
            out.append(f"{role}:{after[i][2] if edit == 'R' else ''}")
        elif edit == "K":
            out.append(f"{after[i][1]}:{after[i][2]}")
            state = 1 + "sua".index(after[i][1][0])
        i += edit != "I"
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (conv, gaps, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)


def odd_conversations():
    rng = random.Random(9)
    texts = ["Yes.", "No!", "And then", "", " \t", None, "Why? ", "ünï 😀.", "long " * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, t, rng.choice(roles[:4]) if rng.random() < 0.7 else rng.choice(roles), rng.choice(texts))
            for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in (None, None, 0, 1, 1, 5)]
    rows += [(99, None, "user", "Hi."), (99, None, None, None), (98, 2, "user", "Twice."), (98, 2, "user", "Twice."), (97, 3, None, None)]
    rows += [(77, t, ("user", "assistant")[t % 2 ^ (t % 11 == 0)], f"Turn {t % 40}." if t % 7 else "Open") for t in range(700)]
    return rows


@pytest.mark.parametrize("bits", [None, (3, 1), (2, 2)])
def test_op12_on_edges(spark, tmp_path, monkeypatch, bits):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = {c: F.lit(1) for c in ("at", "seg", "place", "letter", "digest", "copy", "cost", "first")}
    df.withColumns(extra).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    if bits:  # a conversation is many segments, and these are several levels
        whole = repair.repair
        monkeypatch.setattr(repair, "repair", lambda c: whole(c, *bits))
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = [plain_repair(c, [r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_op12_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    summaries, turns = repair.repair(empty)
    assert summaries.count() == turns.count() == repair.digests(turns).count() == 0


# ---- document fingerprints


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = words_of(words)
    one = fingerprints.WordHashes()
    mixed = lambda x: int(fingerprints._mixed(np.array([x % 2**64], "uint64"))[0])
    h = [one[w.encode()] for w in words]
    terms = [mixed(3 * a + b) for a, b in zip(h, h[1:])] or [mixed(x) for x in h]
    weight = {t: terms.count(t).bit_length() for t in set(terms)}
    return sum(1 << b for b in range(64) if sum(w if t >> b & 1 else -w for t, w in weight.items()) > 0)


def plain_op13(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        a, b, c = plain_print(text), plain_print(new), plain_print(following)
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), f"{a:016x}", f"{b:016x}",
                    1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64))
    near = [sum(j != i and (int(a[3], 16) ^ int(b[3], 16)).bit_count() <= 3 for j, b in enumerate(out)) for i, a in enumerate(out)]
    return [(*row, n) for row, n in zip(out, near)]


@pytest.mark.parametrize("tasks", [1, 7])
def test_op13_on_edges(spark, tmp_path, monkeypatch, tasks):
    short = [(i, t if i != 6 else "alpha beta " * 50) for i, t in TEXTS]
    df = spark.createDataFrame(short, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "part", "edge", "n")})
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(fingerprints, "shuffle_width", lambda d: tasks)
    got = queries.op13_document_fingerprints(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_op13(short), key=str)


def test_op13_of_one_and_no_rows(spark):
    one = spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")
    assert [r["next_fp"] == r["fp"] for r in fingerprints.beside_next(one).collect()] == [True]
    assert fingerprints.beside_next(no_docs(spark)).count() == 0
    assert fingerprints.near_documents(fingerprints.fingerprints(no_docs(spark))).count() == 0


def test_op13_order_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "shuffle_width", lambda d: 13)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in fingerprints.beside_next(docs).collect()}
    for i, (doc, text) in enumerate(rows):
        new = fingerprints.edited(text, rows[(i + 1) % len(rows)][1])
        assert got[doc] == (len(text), hashlib.sha256(new.encode()).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_some_table_holds_every_pair_within_the_radius(one, flips):
    other = one
    for b in flips:
        other ^= 1 << b
    assert any((one ^ other) & m == 0 for m in fingerprints.tables())


@pytest.mark.parametrize("bucket", [4096, 16])
def test_near_rows_equal_all_pairs(spark, bucket):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for start, count in ((None, 150), (0x0123456789ABCDEF, 300)):
        for _ in range(count):
            x = rng.choice(fps[:60]) if start is None else start
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["fp"]: r["near"] for r in fingerprints.near_rows(df, bucket=bucket).collect()}
    for x in set(signed):
        near = sum(1 <= ((x ^ y) % 2**64).bit_count() <= 3 for y in signed)
        assert got.get(x, 0) == near
