"""Vector lengths and label terms of many texts, without one row per n-gram.

A text has three times as many n-grams as words, and most of them are in no other
text.  Here they are numbers: a task hashes the n-grams of its texts, counts them by
text and deals them into parts by hash.  A part has every occurrence of its n-grams,
so it knows their document frequencies (or is dealt the idf of a given vocabulary),
and adds up the squared weights by text; one more shuffle adds them up over the parts.

N-grams that a label may have pass a bit filter of bounded size, and only those become
rows ``(key, term, tf)``; the join with the labels by the term itself drops the rest.

A term in so many texts that it would fill a part is dealt into several by its text;
each of them is sent the number of texts of the others.  Which terms these are is
guessed from some of the texts and changes the spread only.

Two n-grams of one 64-bit hash would count as one term in a vector's length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from labelloom.functions.arrays import vector_tokens
from labelloom.plans.scratch import materialize, shuffle_width

#: N-grams of a part, of a chunk of texts, and the most texts of a chunk.
PART_GRAMS = 1 << 21
CHUNK_GRAMS = 1 << 21
CHUNK_TEXTS = 1 << 14
#: Bits of the filter of label terms: at most 16 MB are broadcast.
FILTER_BITS = 1 << 27
#: Texts that are looked at for terms of very many texts.
LOOKED_AT = 4_000
_BASE = np.uint64(0xD6E8FEB86659FD93)
_DEALT = "part long, chunk long, hash array<bigint>, n array<int>, doc array<smallint>, idf array<double>, rids array<bigint>"
_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int16()), pa.list_(pa.float64()), pa.list_(pa.int64())]
_DEALT_SCHEMA = pa.schema(list(zip(["part", "chunk", "hash", "n", "doc", "idf", "rids"], _TYPES, strict=True)))
_SUMS = "chunk long, doc array<smallint>, sum array<double>, rids array<bigint>"
_SUMS_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc", pa.list_(pa.int16())), ("sum", pa.list_(pa.float64())), ("rids", pa.list_(pa.int64()))])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of the bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per key, written once: ``rid``, the key, its ``texts`` as words joined by
    spaces, and ``rows``, how many rows it has."""
    words = df.select(key, vector_tokens(F.col(text)).alias("_w"))
    words = words.select(key, F.array_join("_w", " ").alias("_t"), F.size("_w").alias("_n"))
    grouped = words.repartition(shuffle_width(df), key).groupBy(key).agg(
        F.collect_list("_t").alias("texts"), F.sum("_n").alias("words"), F.count(F.lit(1)).alias("rows")
    )
    return materialize(grouped.withColumn("rid", F.monotonically_increasing_id()), "texts")


def gram_hashes(words: list[bytes], sizes: np.ndarray, longest: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place of the first word, hash) of the n-grams of one, two ... words of texts
    given as all their words and their sizes."""
    x = mixed(np.fromiter(map(xxhash.xxh64_intdigest, words), "uint64", len(words)) + np.uint64(1))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    out = []
    for q in range(1, longest + 1):
        at = np.flatnonzero(left >= q)
        run = np.full(len(at), q, "uint64")
        for j in range(q):
            run = run * _BASE + x[at + j]
        out.append((at, mixed(run)))
    return out


def _chunks(docs: list[list[str]]) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray]]:
    """(first document, documents, words, sizes of the texts, document of every word) of
    runs of documents, each a list of texts."""
    first, words, sizes, counts = 0, [], [], []
    for row, texts in enumerate(docs):
        had = len(words)
        for text in texts:
            mine = text.encode().split()
            words += mine
            sizes.append(len(mine))
        counts.append(len(words) - had)
        if 3 * len(words) >= CHUNK_GRAMS or len(counts) == CHUNK_TEXTS or row == len(docs) - 1:
            yield first, len(counts), words, np.array(sizes, "int64"), np.repeat(np.arange(len(counts)), counts)
            first, words, sizes, counts = row + 1, [], [], []


def _counted(words: list[bytes], sizes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, tf) of the distinct n-grams of every document."""
    grams = gram_hashes(words, sizes)
    doc, gram = owner[np.concatenate([at for at, _ in grams])], np.concatenate([h for _, h in grams])
    order = np.argsort(mixed(gram + doc.astype("uint64") * _BASE))
    doc, gram = doc[order], gram[order]
    starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])[: len(doc)])
    return doc[starts], gram[starts], np.diff(np.append(starts, len(doc)))


def _rows(parts: np.ndarray, chunk: int, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each run of equal parts, with the other columns as lists."""
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    ends = np.append(starts, len(parts)).astype("int32")
    given = {"part": pa.array(parts[starts].astype("int64")), "chunk": pa.array(np.full(len(starts), chunk))}
    for field in _DEALT_SCHEMA:
        if field.name in columns:
            values = pa.array(columns[field.name].astype(field.type.value_type.to_pandas_dtype()))
            given[field.name] = pa.ListArray.from_arrays(pa.array(ends), values)
        elif field.name not in given:
            given[field.name] = pa.nulls(len(starts), field.type)
    return pa.record_batch([given[f.name] for f in _DEALT_SCHEMA], schema=_DEALT_SCHEMA)


class Spread:
    """The parts of an n-gram; one of very many texts has several."""

    def __init__(self, parts: int, frequent: list[tuple[int, int]]):
        self.parts = parts
        table = np.array(sorted((h % (1 << 64), n) for h, n in frequent) or [(0, 0)], "uint64").reshape(-1, 2)
        self.hashes, self.salts = table[:, 0].copy(), table[:, 1].astype("int64")

    def salts_of(self, gram: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, gram), len(self.hashes) - 1)
        return np.where(self.hashes[at] == gram, np.maximum(self.salts[at], 1), 1)

    def part(self, gram: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return (mixed(gram + np.asarray(salt).astype("uint64") * _BASE) % np.uint64(self.parts)).astype("int64")


def _sorted_rows(parts: np.ndarray, chunk: int, **columns: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(parts, kind="stable")
    return _rows(parts[order], chunk, **{k: v[order] for k, v in columns.items()})


def _deal(spread: Spread, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The n-grams of a batch (rid, texts) by part."""
    rids = batch.column(0).to_numpy()
    for first, n, words, sizes, owner in _chunks(batch.column(1).to_pylist()):
        chunk = int(rids[first])
        doc, gram, tf = _counted(words, sizes, owner)
        salts = spread.salts_of(gram)
        mine = int(mixed(np.array([chunk], "uint64"))[0] >> np.uint64(33))  # texts of a chunk share the salt
        part = spread.part(gram, mine % salts)
        order = np.argsort(part * CHUNK_TEXTS + doc)
        yield _rows(part[order], chunk, hash=gram[order].view("int64"), n=tf[order], doc=doc[order])
        yield _rows(np.full(n, chunk % spread.parts), chunk, rids=rids[first : first + n])
        if (salts > 1).any():
            known, counts = np.unique(gram[salts > 1], return_counts=True)
            several = spread.salts_of(known)
            which = np.repeat(np.arange(len(known)), several)
            salt = np.arange(len(which)) - np.repeat(np.cumsum(several) - several, several)
            other = salt != mine % several[which]
            which, salt = which[other], salt[other]
            yield _sorted_rows(spread.part(known[which], salt), chunk, hash=known[which].view("int64"), n=counts[which])


def _deal_terms(spread: Spread, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Terms with a number of texts or an idf, to all their parts."""
    words = [t.encode().split(b" ") for t in batch.column(0).to_pylist()]
    gram = term_hashes(words)
    salts = spread.salts_of(gram)
    which = np.repeat(np.arange(len(gram)), salts)
    salt = np.arange(len(which)) - np.repeat(np.cumsum(salts) - salts, salts)
    name = "idf" if batch.schema.names[1] == "idf" else "n"
    values = {name: batch.column(1).to_numpy()[which]}
    return _sorted_rows(spread.part(gram[which], salt), -1, hash=gram[which].view("int64"), **values)


def term_hashes(terms: list[list[bytes]]) -> np.ndarray:
    """The hash of every term, given as its words."""
    sizes = np.array([len(t) for t in terms], "int64")
    out, starts = np.zeros(len(terms), "uint64"), np.cumsum(sizes) - sizes
    for q, (at, hashes) in enumerate(gram_hashes([w for t in terms for w in t], sizes, int(sizes.max(initial=0))), 1):
        mine = sizes == q
        out[mine] = hashes[np.searchsorted(at, starts[mine])]
    return out


def _flat(rows: pa.Table, column: str) -> np.ndarray:
    return rows[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _of_part(table: pa.Table, n_docs: int, least: float, most: float, own: bool) -> pa.Table:
    """Sums of squared weights by document, one row for every chunk."""
    rows = table.filter(table["doc"].is_valid())
    gram, n, doc = _flat(rows, "hash").view("uint64"), _flat(rows, "n"), _flat(rows, "doc")
    others = table.filter(pyarrow.compute.and_(table["doc"].is_null(), table["n" if own else "idf"].is_valid()))
    extra = _flat(others, "hash").view("uint64")
    if own:
        known, back = np.unique(np.concatenate([gram, extra]), return_inverse=True)
        df = np.bincount(back, np.concatenate([np.ones(len(gram)), _flat(others, "n")]), len(known))
        kept = (df >= least) & (df <= most)
        idf = np.where(kept, np.log((1.0 + n_docs) / (1.0 + df)) + 1.0, 0.0)[back[: len(gram)]]
    else:
        order = np.argsort(extra)
        known, values = np.append(extra[order], np.uint64(0)), np.append(_flat(others, "idf")[order], 0.0)
        at = np.minimum(np.searchsorted(known[:-1], gram), len(extra))
        idf = np.where(known[at] == gram, values[at], 0.0)
    weight = (1.0 + np.log(n)) * idf
    row = np.repeat(np.arange(rows.num_rows), pa.compute.list_value_length(rows["hash"]).to_numpy())
    owner = row * CHUNK_TEXTS + doc
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    sums = np.add.reduceat(weight * weight, begins) if len(begins) else np.zeros(0)
    ends = np.append(0, np.searchsorted(row[begins], np.arange(rows.num_rows), "right")).astype("int32")
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (doc[begins].astype("int16"), sums)]
    out = pa.table([pa.array(rows["chunk"].to_numpy()), *lists, pa.nulls(rows.num_rows, pa.list_(pa.int64()))], schema=_SUMS_SCHEMA)
    docs = table.filter(table["rids"].is_valid())
    empty = [pa.nulls(docs.num_rows, _SUMS_SCHEMA.field(c).type) for c in ("doc", "sum")]
    return pa.concat_tables([out, pa.table([docs["chunk"], *empty, docs["rids"]], schema=_SUMS_SCHEMA)])


def _of_chunk(table: pa.Table) -> pa.Table:
    rids = _flat(table.filter(table["rids"].is_valid()), "rids")
    rows = table.filter(table["doc"].is_valid())
    sums = np.bincount(_flat(rows, "doc"), _flat(rows, "sum"), len(rids))
    return pa.table({"rid": pa.array(rids), "norm": pa.array(np.sqrt(sums))})


def _frequent(texts: DataFrame, n_texts: int) -> list[tuple[int, int]]:
    """(hash, parts) of terms in so many texts that one part would be full of them."""
    room = max(PART_GRAMS // 4, 1)
    if n_texts <= room:
        return []
    step = max(1, n_texts // LOOKED_AT)
    some = texts.where(F.pmod(F.xxhash64("rid"), F.lit(step)) == 0).select("texts")

    def count(batches):
        for batch in batches:
            for _, _, words, sizes, owner in _chunks(batch.column(0).to_pylist()):
                _, gram, _ = _counted(words, sizes, owner)
                names, n = np.unique(gram, return_counts=True)
                yield pa.record_batch([pa.array(names.view("int64")), pa.array(n.astype("int64"))], names=["hash", "n"])

    seen = some.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    often = seen.where(F.col("n") * step > room).collect()
    return [(r["hash"], math.ceil(r["n"] * step / room)) for r in often]


def norms(
    texts: DataFrame, key: str, n_docs: int = 0, labels: DataFrame = None, limits: tuple[float, float] = (1, math.inf),
    vocab: DataFrame = None,
) -> DataFrame:
    """``(key, norm)`` of the TF-IDF vectors of ``key_texts``.

    The document frequencies are those of the texts and of the ``labels`` postings
    (term), and only terms within ``limits`` have a weight; with ``vocab`` (term, idf) its
    terms have, and no others.
    """
    total, n_texts = texts.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, math.ceil(3 * total / PART_GRAMS))
    spread = texts.sparkSession.sparkContext.broadcast(Spread(parts, _frequent(texts, n_texts)))
    own = vocab is None

    def of_texts(batches):
        for batch in batches:
            yield from _deal(spread.value, batch)

    def of_terms(batches):
        for batch in batches:
            yield _deal_terms(spread.value, batch)

    terms = labels.groupBy("term").agg(F.count(F.lit(1)).alias("n")) if own else vocab.where("idf IS NOT NULL").select("term", "idf")
    dealt = texts.select("rid", "texts").mapInArrow(of_texts, _DEALT).unionAll(terms.mapInArrow(of_terms, _DEALT))
    width = min(parts, max(shuffle_width(texts), parts // 4))
    sums = dealt.repartition(width, "part").groupBy("part").applyInArrow(
        lambda table: _of_part(table, n_docs, *limits, own), _SUMS
    )
    found = sums.repartition(shuffle_width(texts), "chunk").groupBy("chunk").applyInArrow(_of_chunk, "rid long, norm double")
    return materialize(found.where("norm > 0").join(texts.select("rid", key), "rid").select(key, "norm"), "norms")


def shared_counts(texts: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """``(key, term, tf)`` of ``key_texts`` for all ``terms`` (term), and for a few others,
    each then with every text it is in."""
    names = terms.select("term").distinct()
    size = 1 << 10
    while size < min(16 * names.count(), FILTER_BITS):
        size *= 2

    def slots(batches):
        for batch in batches:
            hashes = term_hashes([t.encode().split(b" ") for t in batch.column(0).to_pylist()])
            yield pa.record_batch([pa.array((hashes & np.uint64(size - 1)).astype("int64"))], names=["slot"])

    bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    found = names.mapInArrow(slots, "slot long").select(F.shiftright("slot", 6).alias("word"), bit.alias("bit"))
    found = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size >> 6, "int64")
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(bits.view("uint64"))

    def pick(batches):
        for batch in batches:
            for first, _, words, sizes, owner in _chunks(batch.column(1).to_pylist()):
                rows, names, counts = [], [], []
                for q, (at, gram) in enumerate(gram_hashes(words, sizes), 1):
                    slot = gram & np.uint64(size - 1)
                    hit = (shared.value[(slot >> np.uint64(6)).astype("int64")] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                    at, gram = at[hit], gram[hit]
                    doc = owner[at]
                    order = np.lexsort((gram, doc))
                    at, gram, doc = at[order], gram[order], doc[order]
                    starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])[: len(doc)])
                    rows.append(doc[starts])
                    counts.append(np.diff(np.append(starts, len(doc))))
                    names += [b" ".join(words[i : i + q]) for i in at[starts].tolist()]
                rows = np.concatenate(rows)
                tf = pa.array(np.concatenate(counts).astype("int64"))
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(rows + first)), pa.array(names, pa.binary()).cast(pa.string()), tf],
                    names=[key, "term", "tf"],
                )

    schema = StructType([StructField(key, texts.schema[key].dataType), StructField("term", StringType()), StructField("tf", LongType())])
    return texts.select(key, "texts").mapInArrow(pick, schema)
