"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

An item counts as leaked if a document holds a passage within SHARE of the
item's words of it in edit distance (words in lower case, ASCII marks dropped).

* Windows of the item's size are proposed where document and item share a word
  q-gram on one diagonal.  With at most k edits on n words some run of
  (n - k) / (k + 1) words is unchanged, so q is chosen to lose no passage.
* Items of more than 2 * PIECE words are searched by parts of about PIECE words, one
  of which has no more than its share of the edits, and verified whole.
* The CGK embedding reads a window by a random walk: step j emits the word at the
  pointer, and a hash of (j, word) decides whether the pointer advances.  Windows
  of small edit distance emit streams of small Hamming distance.  REPEATS walks
  with TABLES tables of SAMPLES emitted words each propose pairs of window and
  item; by these numbers a pair at the full distance is found with a probability
  of about 0.95 a window, and a leaked passage offers several windows.
* Every proposed pair is verified by the exact edit distance of the item to the
  passage around the window.

The items are handled in blocks of bounded size, each one scan of the documents
without a shuffle; the copies of an item count once until the very end.  Windows
and items are walked in groups of about one length and a bounded number of steps,
so a very long item takes memory for itself only.

Nulls and edges: null or empty texts and items match nothing, and items below
MIN_WORDS words are not searched, since so few words prove no leak.  Repeated
documents are reported each, repeated items each by its id.
"""

from __future__ import annotations

import string
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SHARE = 0.2
MIN_WORDS = 5
GRAM = 3
REPEATS = 12
TABLES = 4
SAMPLES = 3
BLOCK_BYTES = 8 << 20
_FLUSH = 400_000
_STEPS = 2_400_000
#: Words of a part of a long item: walks over more drift apart with every edit.
PIECE = 64
_TO_WORDS = bytes.maketrans(
    (string.ascii_uppercase + string.punctuation).encode(),
    (string.ascii_lowercase + " " * len(string.punctuation)).encode(),
)


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


def allowed(n: int, share: float = SHARE) -> int:
    """Edits that an item of n words may have."""
    return int(share * n + 1e-9)


def distance(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``passage``, and that
    part's end (the first of several)."""
    steps = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, "int64")
    for i, word in enumerate(item, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (passage != word))
        best = np.concatenate([[i], best])
        row = np.minimum.accumulate(best - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def _pieces(n: int):
    """Parts of an item that are searched as windows.  An item of more than two
    PIECEs is cut evenly: edits within its share are within that of some part."""
    parts = n // PIECE if n > 2 * PIECE else 1
    return [(j * n // parts, (j + 1) * n // parts) for j in range(parts)]


def _close(met: list[tuple[int, int, int]], reach):
    """(document, item, first start, last start) of proposals of one item in one
    document that lie within its edits of each other; they are verified together."""
    group = None
    for doc, i, start in sorted(met):
        if group and group[:2] == (doc, i) and start - group[3] <= reach(i):
            group = (*group[:3], start)
        else:
            if group:
                yield group
            group = (doc, i, start, start)
    if group:
        yield group


def _alike(lengths: np.ndarray):
    """Row numbers of windows of about one length, as many as _STEPS emissions
    allow, and the width that holds them; one long window widens no short one."""
    level = np.ceil(np.log2(np.maximum(lengths, 1))).astype("int64")
    for one in np.unique(level):
        rows = np.nonzero(level == one)[0]
        width = int(lengths[rows].max())
        step = max(1, _STEPS // (2 * width))
        for at in range(0, len(rows), step):
            yield rows[at : at + step], width


class Block:
    """Items of one block: vocabulary, seeds and tables."""

    def __init__(self, texts: list[str], share: float = SHARE, seed: int = 7):
        self.vocabulary: dict[bytes, int] = {}
        self.items, self.keys = [], []
        for key, text in enumerate(texts):
            words = word_list(text)
            if len(words) >= MIN_WORDS:
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
                self.keys.append(key)
        self.share = share
        self.base = len(self.vocabulary) + 1
        cuts = [(i, a, b) for i, item in enumerate(self.items) for a, b in _pieces(len(item))]
        self.pieces = [self.items[i][a:b] for i, a, b in cuts]
        self.origin = [(i, a) for i, a, _ in cuts]
        self.longest = max(map(len, self.pieces), default=0)
        seeds = defaultdict(set)
        for i, item in enumerate(self.pieces):
            k = allowed(len(item), share)
            q = min(GRAM, (len(item) - k) // (k + 1))
            for at in range(len(item) - q + 1):
                seeds[q].add((self._gram(item[at : at + q]), at, i))
        self.seeds = {q: np.array(sorted(found), "int64") for q, found in seeds.items()}
        draw = np.random.default_rng(seed)
        self.walk = draw.integers(1, 1 << 63, (REPEATS, 2 * self.longest + 1), "uint64") | np.uint64(1)
        self.sample = draw.random((REPEATS, TABLES, SAMPLES))
        self.tables = [defaultdict(list) for _ in range(REPEATS * TABLES)]
        lengths = np.array([len(x) for x in self.pieces], "int64")
        for mine, width in _alike(lengths):
            padded = np.zeros((len(mine), width), "int64")
            for row, i in enumerate(mine):
                padded[row, : lengths[i]] = self.pieces[i]
            for t, keys in enumerate(self._signatures(padded, lengths[mine])):
                for i, key in zip(mine.tolist(), keys.tolist()):
                    self.tables[t][key].append(i)
        self.sorted = [np.array(sorted(t), "uint64") for t in self.tables]

    def _gram(self, words) -> int:
        value = 0
        for w in words:
            value = value * self.base + int(w)
        return value

    def _signatures(self, windows: np.ndarray, lengths: np.ndarray):
        """One array of keys per table: the sampled emissions of each walk.

        Words past the window's length count as 0, however wide the rows are;
        samples are taken from the 2n steps in which a walk reads about n words."""
        rows, width = np.arange(len(windows)), windows.shape[1]
        inside = np.arange(windows.shape[1]) < lengths[:, None]
        symbols = np.hstack([np.where(inside, windows, 0), np.zeros((len(windows), 1), "int64")]).astype("uint64")
        symbols = symbols * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        symbols ^= symbols >> np.uint64(29)
        for r in range(REPEATS):
            at = np.zeros(len(windows), "int64")
            emitted = np.empty((2 * width, len(windows)), "uint64")
            for j in range(2 * width):
                emitted[j] = symbols[rows, at]
                at += ((emitted[j] * self.walk[r, j]) >> np.uint64(63)).astype("int64")
                np.minimum(at, width, out=at)
            for t in range(TABLES):
                key = lengths.astype("uint64")
                for u in self.sample[r, t]:
                    key = (key ^ emitted[(u * 2 * lengths).astype("int64"), rows]) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                yield key

    def proposed(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(start, piece) pairs that collide in a table; ``ids`` are word numbers
        of documents with gaps of zeros."""
        starts, sizes = [], []
        lengths = np.array([len(x) for x in self.pieces], "int64")
        for q, seeds in self.seeds.items():
            grams = ids[: len(ids) - q + 1].copy()
            known = grams > 0
            for j in range(1, q):
                part = ids[j : len(ids) - q + 1 + j]
                grams = grams * self.base + part
                known &= part > 0
            where = np.nonzero(known)[0]
            low = np.searchsorted(seeds[:, 0], grams[where], "left")
            times = np.searchsorted(seeds[:, 0], grams[where], "right") - low
            where, low, times = where[times > 0], low[times > 0], times[times > 0]
            each = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            starts.append(np.repeat(where, times) - seeds[each, 1])
            sizes.append(lengths[seeds[each, 2]])
        if not starts:
            return set()
        windows = np.unique(np.stack([np.concatenate(starts), np.concatenate(sizes)], 1), axis=0)
        found: set[tuple[int, int]] = set()
        padded = np.concatenate([np.zeros(self.longest, "int64"), ids, np.zeros(self.longest, "int64")])
        for mine, width in _alike(windows[:, 1]):
            start, size = windows[mine].T
            words = padded[start[:, None] + self.longest + np.arange(width)]
            for t, keys in enumerate(self._signatures(words, size)):
                spot = np.minimum(np.searchsorted(self.sorted[t], keys), len(self.sorted[t]) - 1)
                for w in np.nonzero(self.sorted[t][spot] == keys)[0]:
                    found.update((int(start[w]), i) for i in self.tables[t][int(keys[w])])
        return found

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text number, item key, edits, end word) of every leaked item."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        number = self.vocabulary.get
        gap = max(self.longest, GRAM)

        def flush(first: int, parts: list[np.ndarray]) -> None:
            begins = np.cumsum([0, *[len(p) + gap for p in parts]])
            ids = np.concatenate([x for p in parts for x in (p, np.zeros(gap, "int64"))])
            met = []
            for start, piece in self.proposed(ids):
                i, offset = self.origin[piece]
                middle = start + len(self.pieces[piece]) // 2
                met.append((max(int(np.searchsorted(begins, middle, "right")) - 1, 0), i, start - offset))
            for doc, i, start, last in _close(met, lambda i: allowed(len(self.items[i]), self.share)):
                n, k = len(self.items[i]), allowed(len(self.items[i]), self.share)
                low = max(int(begins[doc]), start - k)
                high = min(int(begins[doc + 1]) - gap, last + n + k)
                if high - low < n - k:
                    continue  # too short for the item
                edits, end = distance(self.items[i], ids[low:high])
                if edits <= k:
                    where = (first + doc, self.keys[i])
                    best[where] = min(best.get(where, (n, 0)), (edits, low + end - int(begins[doc])))

        if self.items:
            first, parts, size = 0, [], 0
            for row, text in enumerate(texts):
                words = word_list(text)
                parts.append(np.fromiter(map(number, words, repeat(0)), "int64", len(words)))
                size += len(words) + gap
                if size > _FLUSH or row == len(texts) - 1:
                    flush(first, parts)
                    first, parts, size = row + 1, [], 0
        return [(row, key, *v) for (row, key), v in sorted(best.items())]


def blocks(items: DataFrame, share: float = SHARE):
    """Distinct item texts in blocks of about BLOCK_BYTES, as (texts, Block)."""
    texts = items.select("text").where("text IS NOT NULL").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for i in range(n):
        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        found = sorted(r["text"] for r in mine.collect())
        yield found, Block(found, share)


def find_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, edits and end_word (words up to the passage's end) of every
    item leaked into a document; the nearest passage of several."""
    spark = docs.sparkSession
    schema = "doc_id long, item string, edits long, end_word long"
    found = None
    for texts, block in blocks(items, share):
        shared = spark.sparkContext.broadcast((texts, block))

        def search(batches, shared=shared):
            texts, block = shared.value
            for batch in batches:
                leaks = block.leaks(batch.column(1).to_pylist())
                rows = pa.array([x[0] for x in leaks], pa.int64())
                yield pa.record_batch(
                    [
                        batch.column(0).take(rows),
                        pa.array([texts[x[1]] for x in leaks], pa.string()),
                        pa.array([x[2] for x in leaks], pa.int64()),
                        pa.array([x[3] for x in leaks], pa.int64()),
                    ],
                    names=["doc_id", "item", "edits", "end_word"],
                )

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, edits long, end_word long")
    names = items.select("item_id", F.col("text").alias("item"))
    return found.join(names, "item").select("doc_id", "item_id", "edits", "end_word")


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without the documents that hold a leaked item."""
    for _, block in blocks(items, share):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        at = docs.columns.index("text")

        def clean(batches, shared=shared, at=at):
            for batch in batches:
                leaked = {x[0] for x in shared.value.leaks(batch.column(at).to_pylist())}
                yield batch.filter(pa.array([i not in leaked for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
