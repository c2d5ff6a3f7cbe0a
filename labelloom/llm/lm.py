"""Language-model scores from log-frequency Bloom filters.

The model is learned from the documents that are not held out.  It interpolates
word bigrams with class bigrams and words:

    p(w | h) = m * c(h, w) / c(h) + (1 - m) * q(w | h)
    q(w | h) = l * c(class of h, class of w) / c(class of h) * p(w | class of w) + (1 - l) * p(w)

Every bigram of the training words is counted.  Words that make up more than
1/CLASSES of the training tokens are classes of their own, all others share one
class, so there are at most (CLASSES + 1)**2 class bigrams whatever the corpus;
between two words with classes of their own both bigrams are the same, and q is the
model.  The weights l and m depend on the size of c(h) and are those of highest
leave-one-out likelihood: l over all class bigrams, m over all bigrams of the
training words.

Counts are quantised to powers of BASE, and a count of level q is kept as q members
of a Bloom filter; it is read back by probing level after level until one is
missing.  A filter is cut into slices of SLICE_BITS bits.  The class filter is
broadcast whole.  The word filter, which gives c(h), has BITS bits per member and
grows with the vocabulary; it is broadcast in blocks of BLOCK_SLICES slices, with one
scan of the documents for each, and a token is taken in the scan that holds the slice
of the word before it.  At most 20,000 words can each own more than 1/FREQUENT of the
tokens; their exact counts are broadcast instead.

The filter of word bigrams is never broadcast.  Tokens are dealt into parts of about
PART_TOKENS, those of a frequent word by their bigram, all others by their word, so
that a part has every occurrence of its bigrams and of its other words: it fills its
own slices from the training tokens, reads the counts of all tokens from them, adds up
the likelihoods of the training tokens under every weight m and, once m is known, the
scores by document. Both read one exchange.

The base score uses exact counts: those frequent words from the broadcast, all
others counted in their part by XXH64 (two words of one hash would count as one, and
two words before the same word if their 32-bit hashes are equal).

Nulls and edges: a null text is empty and has its end only.  A null doc_id is
never held out.  Without training tokens every probability is 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.plans.scratch import materialize, shuffle_width

FREQUENT = 20_000
CLASSES = 2_000
BASE = 1.5
BITS = 10
PROBES = 7
SLICE_BITS = 1 << 20
BLOCK_SLICES = 512
PART_TOKENS = 1 << 20
RUN = 127
CHUNK_DOCS = 1 << 14
ADD = 0.1
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line break
_CHUNK = 200_000
_WEIGHTS = [i / 20 for i in range(20)]
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_DOC = "doc_id:bigint,held:boolean,tokens:bigint,known:bigint,base:double,score:double"
_DEALT = f"part long, chunk long, key array<bigint>, pair array<int>, word array<smallint>, before array<smallint>, doc array<smallint>, run array<tinyint>, docs array<struct<{_DOC}>>"
_SUMS = f"chunk long, doc array<smallint>, known array<int>, base array<double>, score array<double>, docs array<struct<{_DOC}>>"
_DOC_TYPE = pa.struct([("doc_id", pa.int64()), ("held", pa.bool_()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def token_chunks(texts: list[str | None], size: int = _CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, token hashes, starts of the texts) of runs of texts; every
    text ends with END."""
    first, parts, total = 0, [], 0
    for row, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        hashes = np.empty(len(words) + 1, "uint64")
        hashes[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), "uint64", len(words))
        hashes[-1] = END
        parts.append(hashes)
        total += len(hashes)
        if total >= size or row == len(texts) - 1:
            yield first, np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
            first, parts, total = row + 1, [], 0


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of the bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def level(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype("int64")


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count that stands for a level: the geometric mean of its integers."""
    low, high = np.ceil(BASE ** (levels - 1.0) - 1e-6), np.ceil(BASE**levels * 1.0 - 1e-6) - 1
    return np.where(levels > 0, np.sqrt(low * np.maximum(low, high)), 0.0)


_COUNTS = count_of(np.arange(64))


def _bits(keys: np.ndarray, at: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit positions of level ``at`` of the keys, one array per probe."""
    x = mixed(keys + np.asarray(at).astype("uint64") * _GOLDEN)
    step = (x >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((x + np.uint64(i) * step) & np.uint64(SLICE_BITS - 1)).astype("int64")


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (mixed(keys ^ _GOLDEN) % np.uint64(max(slices, 1))).astype("int64")


def fill(keys: np.ndarray, levels: np.ndarray) -> bytes:
    """One slice with all levels of the keys."""
    bits = np.zeros(SLICE_BITS, bool)
    for at in range(1, int(levels.max(initial=0)) + 1):
        for where in _bits(keys[levels >= at], at):
            bits[where] = True
    return np.packbits(bits, bitorder="little").tobytes()


class CountFilter:
    """Slices first, first + 1, ... of a filter of ``slices`` slices."""

    def __init__(self, slices: int, first: int, parts: list[bytes]):
        self.slices, self.first = slices, first
        self.parts = np.frombuffer(b"".join(parts), "uint8").reshape(len(parts), -1) if parts else np.zeros((0, 1), "uint8")
        self.read = np.zeros(0, "int8")

    def held(self, keys: np.ndarray) -> np.ndarray:
        """Whether a key's slice is here."""
        at = slice_of(keys, self.slices) - self.first
        return (at >= 0) & (at < len(self.parts))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts of keys whose slices are here."""
        return count_of(self.levels(keys))

    def code_counts(self, codes: np.ndarray, size: int) -> np.ndarray:
        """Quantised counts of codes below ``size``; a code is looked up once."""
        if not self.slices:
            return np.zeros(len(codes))
        if not len(self.read):
            self.read = np.full(size, -1, "int8")
        new = np.unique(codes[self.read[codes] < 0])
        self.read[new] = self.levels(new.astype("uint64"))
        return _COUNTS[self.read[codes]]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        levels = np.zeros(len(keys), "int64")
        alive, row = np.arange(len(keys)), slice_of(keys, self.slices) - self.first
        at = 1
        while len(alive) and len(self.parts):
            hit = np.ones(len(alive), bool)
            for bit in _bits(keys[alive], at):
                hit &= (self.parts[row[alive], bit >> 3] >> (bit & 7) & 1).astype(bool)
            alive = alive[hit]
            levels[alive] = at
            at += 1
        return levels


def _counted(docs: DataFrame, codes, kind: str) -> DataFrame:
    """(key, n): codes(chunk of token hashes) counted over ``docs`` (text)."""

    def count(batches):
        for batch in batches:
            for _, hashes, _ in token_chunks(batch.column(0).to_pylist()):
                keys, n = np.unique(codes(hashes), return_counts=True)
                yield pa.record_batch([pa.array(keys.view("int64")), pa.array(n.astype("int64"))], names=["key", "n"])

    rows = docs.select("text").mapInArrow(count, "key long, n long")
    return materialize(rows.groupBy("key").agg(F.sum("n").alias("n")), kind)


def _slices(entries: DataFrame) -> tuple[DataFrame, int]:
    """Filled slices (slice, bits) of entries (key, n), and how many there are."""
    members = entries.agg(F.sum(1 + F.floor(F.log(F.col("n")) / F.log(F.lit(BASE)) + 1e-9)).alias("m")).first()["m"] or 0
    slices = -(-members * BITS // SLICE_BITS)

    def deal(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            yield pa.record_batch([pa.array(slice_of(keys.view("uint64"), slices)), *batch.columns], names=["slice", "key", "n"])

    def build(part: pa.Table) -> pa.Table:
        keys, n = part["key"].to_numpy().astype("int64").view("uint64"), part["n"].to_numpy()
        return pa.table({"slice": part["slice"][:1], "bits": pa.array([fill(keys, level(n))], pa.binary())})

    dealt = entries.select("key", "n").mapInArrow(deal, "slice long, key long, n long")
    return materialize(dealt.groupBy("slice").applyInArrow(build, "slice long, bits binary"), "filter"), slices


def _block(filled: DataFrame, slices: int, first: int, size: int) -> CountFilter:
    rows = filled.where(F.col("slice").between(first, first + size - 1)).collect()
    empty = bytes(SLICE_BITS // 8)
    found = {r["slice"]: bytes(r["bits"]) for r in rows}
    return CountFilter(slices, first, [found.get(i, empty) for i in range(first, min(first + size, slices))])


class Model:
    """What a worker needs besides the filters."""

    def __init__(self, tokens: int, words: int, frequent: list[tuple[int, int]]):
        self.tokens, self.norm = tokens, tokens + ADD * (words + 1)
        table = np.array(frequent or [(0, 0)], "int64").reshape(-1, 2)
        table = table[np.argsort(table[:, 0].view("uint64"))]
        self.hashes, self.counts = table[:, 0].copy().view("uint64"), table[:, 1]
        own = self.counts * CLASSES > tokens
        self.classes = int(own.sum())
        self.class_of = np.where(own, np.cumsum(own) - 1, self.classes)
        self.class_counts = np.append(self.counts[own], tokens - self.counts[own].sum())
        self.rare_norm = self.class_counts[-1] + ADD * (words - self.classes + 1)
        self.weights = np.zeros(64)
        self.pair_weights = np.zeros(64)
        # tokens of held-out documents come on top, one document in ten
        often = int(self.counts.sum())
        self.parts = [max(1, -(-n // PART_TOKENS)) for n in (tokens - often, often)]

    def frequent(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether, where) a hash is a frequent word."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return (self.hashes[at] == hashes) & (self.counts[at] > 0), at

    def bigrams(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of the class bigrams; a text starts after an end."""
        known, at = self.frequent(np.concatenate([[END], hashes]))
        classes = np.where(known, self.class_of[at], self.classes)
        return (classes[:-1] * (self.classes + 1) + classes[1:]).astype("uint64")


def fit_weights(model: Model, bigrams: DataFrame) -> np.ndarray:
    """Leave-one-out weight of the bigram by the binary size of c(h)."""
    spark, size = bigrams.sparkSession, model.classes + 1
    counts = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(model.class_counts)], "cls long, c long"))
    rows = (
        bigrams.select(F.col("n"), F.floor(F.col("key") / size).alias("h"), (F.col("key") % size).alias("w"))
        .join(counts.withColumnsRenamed({"cls": "h", "c": "ch"}), "h")
        .join(counts.withColumnsRenamed({"cls": "w", "c": "cw"}), "w")
    )
    two = (F.col("n") - 1) / F.greatest(F.col("ch") - 1, F.lit(1))
    one = F.greatest(F.col("cw") - 1, F.lit(ADD)) / F.lit(float(max(model.tokens - 1, 1)))
    gains = [F.sum(F.col("n") * F.log(w * two + (1 - w) * one)).alias(f"g{i}") for i, w in enumerate(_WEIGHTS)]
    out = np.zeros(64)
    for r in rows.groupBy(F.floor(F.log2("ch")).alias("size")).agg(*gains).collect():
        if r["size"] is not None and r["size"] >= 0:
            out[int(r["size"])] = _WEIGHTS[max(range(len(_WEIGHTS)), key=lambda i: r[f"g{i}"])]
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def _sizes(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts, 1)).astype("int64")


def class_score(model: Model, pairs: CountFilter, before: np.ndarray, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
    """q(w | h) for classes before and cls and the count of w."""
    size = model.classes + 1
    two = pairs.code_counts(before * size + cls, size * size)
    history = model.class_counts[before]
    inside = np.where(cls < model.classes, 1.0, (count + ADD) / model.rare_norm)
    weight = model.weights[_sizes(history)]
    return weight * np.minimum(two / np.maximum(history, 1), 1.0) * inside + (1 - weight) * (count + ADD) / model.norm


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype("int32")), pa.array(values))


def _deal(model: Model, pairs: CountFilter, words: CountFilter, batch: pa.RecordBatch, first: bool) -> Iterator[pa.RecordBatch]:
    """The tokens of a chunk of documents by part: before (which frequent word comes
    before, or FREQUENT and the level of another), key (the word) and, after a word that
    is not frequent, pair (its hash); of a frequent word, word (which) and, after a word
    that is not frequent, key (the bigram). The rest follows from these.  doc (twice the
    place in the chunk, one more if held out) and run (tokens, up to RUN) say whose the
    tokens are.  In the first scan the documents themselves, with their sums over tokens
    between words with classes of their own, go to one of the parts."""
    rids, held = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
    rare_parts, often_parts = model.parts
    end_known, end_at = (x[0] for x in model.frequent(np.array([END])))
    # a row for every part, so chunks grow with their number
    for start, hashes, begins in token_chunks(batch.column(3).to_pylist(), max(_CHUNK, 100 * sum(model.parts))):
        n, total = len(begins), len(hashes)
        sizes = np.diff(np.append(begins, total))

        def earlier(x, end, begins=begins):
            out = np.roll(x, 1)
            out[begins] = end
            return out

        known, at = model.frequent(hashes)
        h, h_known, h_at = earlier(hashes, END), earlier(known, end_known), earlier(at, end_at)
        cls = np.where(known, model.class_of[at], model.classes)
        h_cls = np.where(h_known, model.class_of[h_at], model.classes)
        own = (cls < model.classes) & (h_cls < model.classes)
        key = np.where(known, mixed(h + mixed(hashes)), hashes)
        place = mixed(key ^ _GOLDEN)
        part = np.where(known, place % np.uint64(often_parts), place % np.uint64(rare_parts)).astype("int64")
        where = np.flatnonzero(~own)
        part += rare_parts * known
        # c(h): the first scan has the frequent words, each scan the others of its slices
        level_of, here = np.zeros(len(where), "int64"), np.full(len(where), first)
        cold = ~h_known[where]
        distinct, back = np.unique(h[where][cold], return_inverse=True)
        mine, levels = words.held(distinct), np.zeros(len(distinct), "int64")
        levels[mine] = words.levels(distinct[mine])
        level_of[cold], here[cold] = levels[back], (mine | (first and not words.slices))[back]
        before = np.where(cold, FREQUENT + level_of, h_at[where]).astype("int16")
        order = np.flatnonzero(here)
        kind = "uint16" if sum(model.parts) < 1 << 16 else "int64"  # short numbers are sorted by radix
        order = order[np.argsort(part[where][order].astype(kind), kind="stable")]
        before, where = before[order], where[order]
        numbers, starts = np.unique(part[where], return_index=True)
        ends = np.append(starts[1:], len(where))[: len(numbers)]
        frequent, cold = known[where], before >= FREQUENT
        doc = (2 * np.repeat(np.arange(n), sizes)[where] + np.repeat(held[start : start + n], sizes)[where]).astype("int16")
        row = np.repeat(np.arange(len(numbers)), ends - starts)
        changes = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        runs = np.flatnonzero((np.arange(len(where)) - np.repeat(changes, np.diff(np.append(changes, len(where))))) % RUN == 0)
        if len(numbers):
            chosen = (
                (key[where].view("int64"), ~frequent | cold),
                ((mixed(h[where]) >> np.uint64(32)).astype("uint32").view("int32"), ~frequent & cold),
                (at[where].astype("int16"), frequent),
            )
            lists = [_lists(x[some], np.cumsum(some)[ends - 1]) for x, some in chosen]
            lists.append(_lists(before, ends))
            counts = np.diff(np.append(runs, len(where))).astype("int8")
            lists += [_lists(x, np.searchsorted(runs, ends)) for x in (doc[runs], counts)]
            chunk = pa.array(np.full(len(numbers), rids[start]))
            yield pa.record_batch([pa.array(numbers), chunk, *lists, pa.nulls(len(numbers), pa.list_(_DOC_TYPE))], names=_DEALT_NAMES)
        if first:
            count = model.counts[at[own]]
            base, score = np.zeros(total), np.zeros(total)
            base[own] = np.log10((count + ADD) / model.norm)
            score[own] = np.log10(class_score(model, pairs, h_cls[own], cls[own], count))
            columns = [batch.column(1).slice(start, n).cast(pa.int64()), batch.column(2).slice(start, n), pa.array(sizes)]
            columns += [pa.array(np.add.reduceat(x, begins)) for x in (own.astype("int64"), base, score)]
            docs = pa.ListArray.from_arrays(pa.array([0, n], "int32"), pa.StructArray.from_arrays(columns, fields=list(_DOC_TYPE)))
            number = int(mixed(rids[start : start + 1].view("uint64"))[0] % np.uint64(rare_parts + often_parts))
            empty = [pa.nulls(1, pa.list_(t)) for t in (pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int16(), pa.int8())]
            yield pa.record_batch([pa.array([number]), pa.array(rids[start : start + 1]), *empty, docs], names=_DEALT_NAMES)


_DEALT_NAMES = ["part", "chunk", "key", "pair", "word", "before", "doc", "run", "docs"]


def _flat(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].combine_chunks().flatten().to_numpy()


class Part:
    """The tokens of one part by their bigrams, and the counts of these and their words."""

    def __init__(self, model: Model, pairs: CountFilter, rows: pa.Table):
        key, pair, word, before, doc, run = (_flat(rows, c) for c in ("key", "pair", "word", "before", "doc", "run"))
        # runs end with their row
        doc = np.repeat(doc, run)
        self.doc, training = doc >> 1, (doc & 1) == 0
        known, hashes = before < FREQUENT, model.hashes
        often = rows.num_rows and rows["part"][0].as_py() >= model.parts[0]
        codes = np.empty(len(before), "uint64")
        if often:
            codes[~known] = key.view("uint64")
            codes[known] = mixed(hashes[before[known]] + mixed(hashes[word[known]]))
            codes = mixed(codes + mixed(word.astype("uint64")))
        else:
            codes[~known] = pair.view("uint32")
            codes[known] = mixed(hashes[before[known]]) >> np.uint64(32)
            codes = mixed(key.view("uint64") + mixed(codes))
        bigrams, self.of = np.unique(codes, return_inverse=True)
        del codes
        # all that follows is the same for all tokens of a bigram
        one = np.empty(len(bigrams), "int64")
        one[self.of] = np.arange(len(before))
        self.training = np.bincount(self.of[training], minlength=len(bigrams))
        self.pair = self._filter(bigrams, self.training).counts(bigrams)
        if often:
            self.count, cls = model.counts[word[one]], model.class_of[word[one]]
        else:
            words, back = np.unique(key[one], return_inverse=True)
            self.count = np.bincount(back, self.training, len(words)).astype("int64")[back]
            cls = model.classes
        before, known = before[one], known[one]
        index = np.where(known, before, 0)
        self.history = np.where(known, model.counts[index], _COUNTS[np.where(known, 0, before - FREQUENT)])
        h_cls = np.where(known, model.class_of[index], model.classes)
        # leave-one-out: without the token itself
        self.lower = lambda less: class_score(model, pairs, h_cls, cls, np.maximum(self.count - less, 0))

    @staticmethod
    def _filter(bigrams: np.ndarray, n: np.ndarray) -> CountFilter:
        bigrams, levels = bigrams[n > 0], level(n[n > 0])
        slices = int(-(-levels.sum() * BITS // SLICE_BITS))
        at = slice_of(bigrams, slices)
        return CountFilter(slices, 0, [fill(bigrams[at == i], levels[at == i]) for i in range(slices)])


def _gains(model: Model, pairs: CountFilter, table: pa.Table) -> pa.Table:
    """size (of c(h)) and the log-likelihood of a part's training tokens by weight,
    each token left out of the counts that score it."""
    part = Part(model, pairs, table.filter(table["before"].is_valid()))
    seen = (part.training > 0) & (part.history > 0)
    two = np.minimum(np.maximum(part.pair - 1, 0) / np.maximum(part.history - 1, 1), 1.0)[seen]
    one, n, sizes = part.lower(1)[seen], part.training[seen], _sizes(part.history[seen])
    columns = [np.bincount(sizes, n * np.log(w * two + (1 - w) * one), 64).astype("float64") for w in _WEIGHTS]
    return pa.table([pa.array(np.arange(64)), *map(pa.array, columns)], names=["size", *[f"g{i}" for i in range(len(columns))]])


def _sums(model: Model, pairs: CountFilter, table: pa.Table) -> pa.Table:
    """Sums over a part's tokens by document, one row for every chunk, and the
    documents dealt to it."""
    rows = table.filter(table["before"].is_valid()).combine_chunks()
    part = Part(model, pairs, rows)
    row = np.repeat(np.arange(rows.num_rows), pa.compute.list_value_length(rows["before"]).to_numpy())
    # tokens come by row and by document
    owner = row << 16 | part.doc
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    weight = np.where(part.history > 0, model.pair_weights[_sizes(part.history)], 0.0)
    p = weight * np.minimum(part.pair / np.maximum(part.history, 1), 1.0) + (1 - weight) * part.lower(0)
    ends = np.searchsorted(row[begins], np.arange(rows.num_rows), "right")
    add = lambda x: np.add.reduceat(x, begins) if len(begins) else x
    known = add((part.count > 0).astype("int64")[part.of])
    base, score = add(np.log10((part.count + ADD) / model.norm)[part.of]), add(np.log10(p)[part.of])
    values = part.doc[begins], known.astype("int32"), base, score
    given = pa.array(rows["chunk"].to_numpy())
    out = pa.table([given, *[_lists(x, ends) for x in values], pa.nulls(rows.num_rows, pa.list_(_DOC_TYPE))], names=_SUMS_NAMES)
    docs = table.filter(table["docs"].is_valid()).select(["chunk", "docs"])
    for i, name in enumerate(_SUMS_NAMES[1:-1], 1):
        docs = docs.add_column(i, name, pa.nulls(docs.num_rows, out.schema.field(name).type))
    return pa.concat_tables([out, docs.cast(out.schema)])


_SUMS_NAMES = ["chunk", "doc", "known", "base", "score", "docs"]


def _documents(table: pa.Table) -> pa.Table:
    """The documents of one chunk with their sums over all parts."""
    docs = table["docs"].combine_chunks().flatten()
    at, n = _flat(table, "doc"), len(docs)
    out = {name: docs.field(i) for i, name in enumerate(("doc_id", "held_out", "n_tokens"))}
    for column, name, i, kind in (("known", "n_known", 3, "int64"), ("base", "base_score", 4, "float64"), ("score", "score", 5, "float64")):
        out[name] = pa.array((np.bincount(at, _flat(table, column), n) + docs.field(i).to_numpy()).astype(kind))
    return pa.table(out)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of
    every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    training = rows.where(~F.col("held"))
    counts = _counted(training, lambda hashes: hashes, "unigrams")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    is_frequent = F.col("n") * FREQUENT > total["n"]
    frequent = [(r["key"], r["n"]) for r in counts.where(is_frequent).collect()]
    model = Model(total["n"], total["v"], frequent)
    shared = spark.sparkContext.broadcast(model)
    pairs = _counted(training, lambda hashes: shared.value.bigrams(hashes), "bigrams")
    model.weights = fit_weights(model, pairs)
    pair_slices, n_pairs = _slices(pairs)
    word_slices, n_words = _slices(counts.where(~is_frequent))
    pair_filter = spark.sparkContext.broadcast((model, _block(pair_slices, n_pairs, 0, max(n_pairs, 1))))

    dealt = None
    for at in range(0, max(n_words, 1), BLOCK_SLICES):
        block = spark.sparkContext.broadcast(_block(word_slices, n_words, at, BLOCK_SLICES))

        def scan(batches, block=block, first=at == 0):
            known, pairs = pair_filter.value
            for batch in batches:
                # places in a chunk are short numbers
                for start in range(0, batch.num_rows, CHUNK_DOCS):
                    yield from _deal(known, pairs, block.value, batch.slice(start, CHUNK_DOCS), first)

        part = rows.mapInArrow(scan, _DEALT)
        dealt = part if dealt is None else dealt.unionAll(part)
    dealt = dealt.repartition(min(sum(model.parts), shuffle_width(docs)), "part")

    names = [f"g{i}" for i in range(len(_WEIGHTS))]
    gains = dealt.groupBy("part").applyInArrow(lambda part: _gains(*pair_filter.value, part), "size long, " + ", ".join(f"{g} double" for g in names))
    totals = gains.groupBy("size").agg(F.array(*[F.sum(g) for g in names]).alias("g"))
    best = (F.array_position("g", F.array_max("g")) - 1).cast("int")
    fitted = totals.agg(F.collect_list(F.struct(F.col("size").cast("int").alias("size"), best.alias("best"))).alias("fitted"))

    def scored(part: pa.Table) -> pa.Table:
        known, pairs = pair_filter.value
        known.pair_weights = np.zeros(64)
        for fit in part["fitted"][0].as_py():
            known.pair_weights[fit["size"]] = _WEIGHTS[fit["best"]]
        return _sums(known, pairs, part)

    # the best weights, one row, come as a column, so that one plan deals the tokens once
    both = dealt.join(F.broadcast(fitted))
    sums = both.groupBy("part").applyInArrow(scored, _SUMS).repartition(shuffle_width(docs), "chunk")
    scores = sums.groupBy("chunk").applyInArrow(
        _documents, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scores.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
