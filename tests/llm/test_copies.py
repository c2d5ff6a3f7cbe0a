"""SimHash, fuzzy lines, near copies and components against brute force."""

import random
import time

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from labelloom.llm import copies, lines, simhash
from labelloom.llm.graph import components
from labelloom.llm.neighbours import verified_forest
from tests.llm.common import SF, TEXTS, edge_docs, no_docs, union_find


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_masks_cover_every_pair_within_the_radius(one, flips):
    other = one
    for b in flips:
        other ^= 1 << b
    assert any((one ^ other) & m == 0 for m in simhash.masks(list(range(64))))


def test_simhash_on_edges(spark):
    rows = simhash.near_duplicates(edge_docs(spark)).collect()
    prints = [plain_fingerprint(t) for _, t in TEXTS]
    assert sorted(r["fp"] % 2**64 for r in rows) == sorted(prints)
    near = [(i, j) for i in range(len(TEXTS)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = union_find(near, len(TEXTS))
    least = {}
    for i, (doc, _) in enumerate(TEXTS):
        if doc is not None:
            least[root[i]] = min(least.get(root[i], doc), doc)
    want = sorted((str(doc), str(least.get(root[i]))) for i, (doc, _) in enumerate(TEXTS))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == want
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def test_large_buckets_are_dealt_again(spark):
    rng = random.Random(3)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 400:  # one dense cloud and some noise
        x = rng.choice(sorted(fps))
        for _ in range(rng.choice([1, 2, 3, 6])):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(x - 2**64 if x >> 63 else x for x in fps)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    near = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) % 2**64).bit_count() <= 4]
    want = union_find(near, len(fps))
    number = {x: i for i, x in enumerate(fps)}
    for bucket in (4096, 8):
        found = [(number[r["a"]], number[r["b"]]) for r in simhash.links(table, bucket=bucket).collect()]
        assert union_find(found, len(fps)) == want


def test_components(spark):
    rng = random.Random(5)
    n = 400
    pairs = [(i, i + 1) for i in range(0, 150)] + [(200, x) for x in range(201, 300)]
    pairs += [(rng.randrange(300, n), rng.randrange(300, n)) for _ in range(40)]
    root = union_find(pairs, n)
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["vertex"]: r["root"] for r in rows} == {x: root[x] for p in pairs for x in p if p[0] != p[1]} | {
        x: root[x] for p in pairs for x in p if root.count(root[x]) > 1
    }
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_lines(texts):
    """Groups of occurrences (doc_id, text, line) by brute force."""
    found = list(lines.line_hashes([t for _, t in texts]))
    n = len(found)
    links = [
        (i, j)
        for i in range(n)
        for j in range(i)
        if found[i][2] == found[j][2] or lines.similar(found[i][3].astype("u4"), found[j][3].astype("u4"))
    ]
    root = union_find(links, n)
    return [(texts[x[0]], x[1], root[i]) for i, x in enumerate(found)], root


def test_lines_against_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(6)]
    texts = []
    for i in range(40):
        body = []
        for line in rng.sample(base, 3):
            words = line.split()
            if rng.random() < 0.6:
                words[rng.randrange(60)] = f"new{rng.randrange(9)}"
            body.append(" ".join(words))
        texts.append((i, "\n".join([*body, "too short"])))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    occurrences, root = plain_lines(texts)
    first = {}
    for (doc, _), line, r in occurrences:
        first[r] = min(first.get(r, (doc, line)), (doc, line))
    want = sorted(
        (doc, line, *first[r], (doc, line) == first[r]) for (doc, _), line, r in occurrences if root.count(r) > 1
    )
    got = lines.repeated_lines(docs).select("doc_id", "line", "kept_doc_id", "kept_line", "kept").collect()
    assert sorted(map(tuple, got)) == want
    assert any(not w[4] for w in want)


def named(i):
    """A word of letters: digits of lines count as one."""
    return "".join(chr(97 + int(c)) for c in str(i))


def test_line_candidates_reach_every_pair_at_the_similarity(spark):
    rng = random.Random(12)

    def edit(words, edits):
        words = list(words)
        for _ in range(edits):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 1)] = [] if kind == 0 else [named(rng.randrange(10**6))]
        return words

    texts: list[list[str]] = []
    for n in [*range(5, 33), *range(36, 200, 30)] * 2:
        words = [named(rng.randrange(3000)) for _ in range(n)]
        texts += [words, edit(words, max(1, int(0.2 * n))), edit(words, 1)]
    distinct = {x[2]: x[3].astype("<u4") for x in lines.line_hashes([" ".join(w) for w in texts])}
    digests, found = {d: i for i, d in enumerate(distinct)}, list(distinct.values())
    near = {(j, i) for i in range(len(found)) for j in range(i) if lines.similar(found[i], found[j])}
    rows = [(d, w.tobytes()) for d, w in distinct.items()]
    table = spark.createDataFrame(rows, "digest binary, words binary")
    got = {tuple(sorted((digests[bytes(r["a"])], digests[bytes(r["b"])]))) for r in lines.near_links(table).collect()}
    assert got <= near and len(near) > 100
    upto = {p for p in near if max(len(found[p[0]]), len(found[p[1]])) <= lines.RUNS}
    assert upto <= got and len(got) >= 0.96 * len(near)


def test_short_lines_count_by_their_exact_text(spark):
    docs = spark.createDataFrame([(1, "Menu\n***\n\nHome page"), (2, "menu!\n***\nhome"), (3, "---")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["line"], r["kept"]) for r in lines.repeated_lines(docs, shortest=0).collect())
    assert got == [(1, 0, True), (1, 1, True), (2, 0, False), (2, 1, False)]
    assert lines.repeated_lines(docs).count() == 0 and lines.dedup_lines(docs).count() == 3


def test_only_shared_line_keys_are_gathered(spark):
    """Keys of one line, also of one that comes several times, are told by 32 bits; no
    key that two lines have is missed, however small the filter."""
    rng = random.Random(9)
    content = [[rng.randrange(1 << 32) for _ in range(rng.choice([5, 7, 9, 12, 17, 30, 60]))] for _ in range(3000)]
    content += [[*c[:-1], 7] for c in content[:300]]
    blobs = [np.array(c, "<u4") for c in content]
    rows = spark.createDataFrame([(i, b.tobytes()) for i, b in enumerate(blobs)], "id long, words binary")
    owner, keys = lines.line_keys(np.concatenate(blobs), np.array([len(b) for b in blobs]))
    found, n = np.unique(keys, return_counts=True)
    shared = found[n > 1]
    assert len(shared) > 1000
    kept = lines.shared_keys(rows, 8)
    assert kept.held(shared).all() and kept.held(found[n == 1]).mean() < 0.1
    tight = lines.SharedKeys(kept.bits, [], 8)
    assert not tight.held(found).any()
    bits, lines.FILTER_BITS = lines.FILTER_BITS, 1 << 12
    try:
        assert lines.shared_keys(rows, 8).held(shared).all()
    finally:
        lines.FILTER_BITS = bits


def test_hot_line_keys_are_searched_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(lines, "SMALL", 2)
    monkeypatch.setattr(lines, "BUCKET", 8)
    words = [named(i) for i in range(20)]
    texts = [(i, " ".join(words[:18] + ["x" + named(i), "y" + named(i)])) for i in range(40)] + [(99, " ".join(words[:8] + words[:1] * 12))]
    rows = lines.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(40)) and {r["kept_doc_id"] for r in rows} == {0}


def test_line_dedup_edges(spark):
    docs = edge_docs(spark)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == TEXTS[0][1] and rows[2]["text"] == TEXTS[1][1].split("\n")[1]
    assert rows[11]["text"] == "one two three four five\nshort\nshort"
    assert rows[11]["n_chars"] == len(rows[11]["text"])
    assert rows[3]["text"] is None and rows[4]["text"] == "" and rows[5]["text"] == TEXTS[4][1]
    assert out.where("doc_id = 9").count() == 2  # repeated rows count as one document
    assert lines.dedup_lines(no_docs(spark)).count() == 0


def test_similar_is_edit_similarity():
    a = np.arange(20)
    assert lines.similar(a, np.delete(a, [3, 9]))
    assert lines.similar(a, np.insert(a, 5, [99, 98, 97, 96]))
    assert not lines.similar(a, a[::-1])
    assert not lines.similar(a, np.delete(a, range(5)))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edits_are_counted_on_bits():
    rng = random.Random(6)
    for n in [0, 1, 2, 7, 20, 63, 64, 65, 130]:
        for _ in range(20):
            pool = rng.choice([2, 6, 1 << 31])
            a = [rng.randrange(pool) for _ in range(n)]
            b = [w for w in a if rng.random() > 0.1]
            for _ in range(rng.randrange(3)):
                b.insert(rng.randrange(len(b) + 1), rng.randrange(pool))
            far = edits(a, b)
            assert lines.within(lines.places(a), n, b, far)
            assert not lines.within(lines.places(a), n, b, far - 1)


def test_long_lines_of_the_same_words_are_compared_fast():
    rng = random.Random(7)
    parts = [[rng.randrange(1 << 31) for _ in range(26)] for _ in range(5)]
    content = [np.array(sum(rng.sample(parts, 5), []), "<u4") for _ in range(160)]
    begun = time.process_time()
    links = list(lines.line_forest(content, 0.8))
    spent = time.process_time() - begun
    begun = time.process_time()
    for i in range(160):  # the measure: 160 pairs by a plain table
        edits(content[0].tolist(), content[i].tolist())
    assert spent < 6 * (time.process_time() - begun)
    roots = union_find(links, len(content))
    orders = {tuple(c.tolist()) for c in content}
    assert len(set(roots)) == len(orders)


def test_a_failed_link_does_not_hide_others():
    # all fingerprints are near, but only two contents are alike
    fps = np.array([0, 1, 2, 3])
    found = list(verified_forest(fps, [np.array([i]) for i in (1, 2, 3, 2)], 3, lambda a, b: a[0] == b[0]))
    assert found == [(1, 3)]


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng = random.Random(2)
    some = sorted(i for i, t in texts.items() if len(t.split()) > 120)[:30]
    for i in some:  # a copy with one edit in sixty words
        words = texts[i].split()
        for at in range(20, len(words), 60):
            words[at] = f"edit{rng.randrange(10**6)}"
        texts[1000 + i] = " ".join(words)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("rid", F.lit(1))
    kept = {r["doc_id"] for r in copies.drop_near_copies(table).collect()}
    ids = sorted(texts)
    sets = [set(simhash.shingle_hashes(texts[i], 5).tolist()) for i in ids]
    near = [
        (i, j) for i in range(len(ids)) for j in range(i)
        if len(sets[i] & sets[j]) >= copies.SIMILARITY * len(sets[i] | sets[j])
    ]
    root = union_find(near, len(ids))
    want = {min(ids[k] for k in range(len(ids)) if root[k] == r) for r in set(root)}
    assert want <= kept and len(kept - want) <= 0.05 * len(near)
    assert len(kept & {1000 + i for i in some if root[ids.index(1000 + i)] == root[ids.index(i)]}) <= 1


def test_shortened_and_extended_copies_are_found():
    rng = random.Random(8)
    found = total = 0
    for n in [100, 300, 1000] * 40:
        words = [named(rng.randrange(5000)) for _ in range(n)]
        more = words + [named(rng.randrange(5000)) for _ in range(int(0.23 * n))]
        for other in (words[: n - int(0.19 * n)], words[int(0.19 * n) :], more):
            a, b = (copies.shingle_set(" ".join(w)) for w in (words, other))
            if copies.jaccard(a, b):
                total += 1
                found += bool(set(copies.band_keys(a)) & set(copies.band_keys(b)))
    assert total > 300 and found >= 0.98 * total


def test_near_copy_edges(spark):
    docs = edge_docs(spark)
    out = copies.drop_near_copies(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 3, 6, 7, 8, 9, None, 11, 12, 13]))
    assert copies.drop_near_copies(no_docs(spark)).count() == 0


def test_large_groups_of_lines_under_shared_keys(spark):
    """Families of near lines and unrelated lines that share runs of words."""
    rng = random.Random(12)
    pool = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    starts = [rng.choices(pool, k=20) for _ in range(3)]
    starts[1][5:10] = starts[0][5:10]  # two families with a common run
    found = []
    for family in starts:
        for _ in range(90):
            words = list(family)
            for at in rng.sample(range(20), rng.randint(0, 3)):
                words[at] = rng.choice(pool)
            found.append(words)
    found += [[*rng.choices(pool, k=9), *starts[0][5:10], *rng.choices(pool, k=9)] for _ in range(100)]
    found = sorted({tuple(w) for w in found})
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(found)], "doc_id long, text string")
    got = lines.lines(texts).select("doc_id", "digest", "words")
    number = {bytes(r["digest"]): r["doc_id"] for r in got.collect()}
    coded = [np.frombuffer(r["words"], "<u4") for r in got.orderBy("doc_id").collect()]
    want = union_find([(i, j) for i in range(len(coded)) for j in range(i) if lines.similar(coded[i], coded[j])], len(coded))
    links = [(number[bytes(r["a"])], number[bytes(r["b"])]) for r in lines.near_links(got.select("digest", "words")).collect()]
    assert union_find(links, len(coded)) == want
    assert all(lines.similar(coded[a], coded[b]) for a, b in links)
    assert len(links) < 9 * len(coded)  # a forest under most keys, not all pairs


def test_simhash_alone_finds_near_copies(spark, monkeypatch):
    rng = random.Random(21)
    texts = []
    for i in range(12):
        words = [named(rng.randrange(5000)) for _ in range(600)]
        texts += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words[:-1]))]
    prints = {d: simhash.fingerprint(simhash.shingle_hashes(t, copies.SHINGLE)) for d, t in texts}
    near = {d for d in prints if d % 10 and ((prints[d] ^ prints[d - 1]) % 2**64).bit_count() <= simhash.RADIUS}
    assert len(near) > 6
    # no two texts share a MinHash key
    rows = [(bytes([i]), prints[d]) for i, (d, _) in enumerate(texts)]
    keys = copies.near_print_keys(spark.createDataFrame(rows, "digest binary, print long")).collect()
    shared = {k: sorted(r["digest"][0] for r in keys if r["fp"] == k) for k in {r["fp"] for r in keys}}
    assert {tuple(v) for v in shared.values()} >= {(i - 1, i) for i, (d, _) in enumerate(texts) if d in near}
    stamped = copies._stamped
    unique = F.array(F.xxhash64("rid", F.lit("no other row has this key")))
    monkeypatch.setattr(copies, "_stamped", lambda docs: stamped(docs).withColumn("fps", unique))
    kept = copies.drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in texts} - near
