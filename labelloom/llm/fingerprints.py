"""Document fingerprints: weighted term hashes vote on signed bits.

The terms of a text are its pairs of adjacent words, A-Z in lower case (a single
word is a term of its own).  A term weighs one more for every doubling of its
count, and its hash votes with that weight for or against each of 64 bits.

``near_rows`` finds all fingerprints within RADIUS bits by permuted block tables:
the bits are cut into BLOCKS blocks, and each table leads with another choice of
BLOCKS - RADIUS of them.  RADIUS differing bits touch at most RADIUS blocks, so
some table has both fingerprints under one key.  Only distinct fingerprints take
part.  A bucket of more than BUCKET is dealt again by tables over the bits that
its key leaves open, until at most 2**OPEN_BITS fingerprints can share a bucket,
whatever the data.  Every pair counts where it first agrees, so a bucket yields
one sum per member and never its pairs.

Nulls and edges: a null, empty or blank text has fingerprint zero, and equal texts
have equal fingerprints.  Every row is a document of its own, repeated rows and
null ids included; rows without an id come last in descending order, equal ids
in the order of a hash of their texts.  One single row is its own next document.
An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.plans.joins import fits_broadcast
from labelloom.plans.scratch import input_bytes, materialize, shuffle_width, width_for

RADIUS = 3
BLOCKS = 6
BUCKET = 4096
OPEN_BITS = 16
SEED = 42
#: Words whose hashes a worker remembers; when full, it starts anew.
REMEMBERED = 400_000
_CHUNK = 1 << 15
#: Bytes of distinct fingerprints whose rows under all tables one task makes.
WIDE_BYTES = 1 << 20


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def fingerprint(text: str, hashes: WordHashes) -> int:
    """The 64 bits as a signed number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    terms = np.fromiter(map(hashes.__getitem__, words), "uint64", len(words))
    if len(terms) > 1:
        terms = terms[:-1] * np.uint64(3) + terms[1:]
    terms, counts = np.unique(_mixed(terms), return_counts=True)
    weights = np.frexp(counts)[1].astype("float64")  # 1 + floor(log2(count)), sums are exact
    votes = np.zeros(64)
    for at in range(0, len(terms), _CHUNK):
        bits = np.unpackbits(terms[at : at + _CHUNK].astype(">u8").view("uint8").reshape(-1, 8), axis=1)
        votes += weights[at : at + _CHUNK] @ (2.0 * bits - 1.0)
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row of ``docs`` (doc_id, text)."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            fps = [fingerprint(t or "", hashes) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return source.mapInArrow(run, source.select("doc_id").schema.add("fp", "long"))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return 1 - F.bit_count(column(a).bitwiseXOR(column(b))) / F.lit(64.0)


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as many first characters of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: What is known of a document once its successor is seen.
_KNOWN = "n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long"
#: A row that starts or ends a partition brings its text along.
_EDGE = "edge string, part integer, text string"


def beside_next(docs: DataFrame) -> DataFrame:
    """Every document with its edited text's digest and fingerprint, and the
    fingerprint of the next document in descending order of doc_id.

    The texts are shuffled once, by ranges of doc_id, and read in order with one
    row in memory.  The first and last text of every partition are written with
    the result, and a small join of these closes the gaps, the last document's
    successor being the first one.
    """
    order = [F.desc_nulls_last("doc_id"), F.col("_hash"), F.col("_row")]
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # equal rows may stand in any order, the number only lets ranges split them
    source = source.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    rows = source.repartitionByRange(shuffle_width(docs), *order).sortWithinPartitions(*order)
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = source.select("doc_id").schema
    for field in f"{_KNOWN}, {_EDGE}".split(", "):
        schema = schema.add(*field.split())

    def known(hashes, text, fp, following, next_fp):
        new = edited(text, following)
        return len(text), hashlib.sha256(new.encode()).hexdigest(), fp, fingerprint(new, hashes), next_fp

    def table(ids, out):
        return pa.record_batch(
            [pa.concat_arrays(ids), *[pa.array(c, _ARROW[f.dataType.typeName()]) for c, f in zip(zip(*out), schema[1:])]],
            names=schema.names,
        )

    def walk(batches):
        hashes, last = WordHashes(), None
        for batch in batches:
            ids, out = [], []
            parts = batch.column(2).to_pylist()
            for i, text in enumerate(batch.column(1).to_pylist()):
                fp, own = fingerprint(text, hashes), batch.column(0).slice(i, 1)
                if last is None:
                    ids.append(own)
                    out.append((len(text), None, fp, None, None, "first", parts[i], text))
                else:
                    ids.append(last[0])
                    out.append((*known(hashes, last[1], last[2], text, fp), None, None, None))
                last = own, text, fp, parts[i]
            if out:
                yield table(ids, out)
        if last:
            yield table([last[0]], [(len(last[1]), None, last[2], None, None, "last", last[3], last[1])])

    def close(batches):
        hashes = WordHashes()
        for batch in batches:
            out = [known(hashes, *row) for row in zip(*[c.to_pylist() for c in batch.columns[1:]])]
            if out:
                yield table([batch.column(0)], [(*row, None, None, None) for row in out])

    found = materialize(rows.mapInArrow(walk, schema), "beside_next")
    firsts = found.where("edge = 'first'").select("part", F.col("text").alias("following"), F.col("fp").alias("next_fp"))
    # one number per partition takes part in this window, no text
    turn = Window.orderBy("part")
    chain = firsts.select("part", F.coalesce(F.lead("part").over(turn), F.min("part").over(Window.partitionBy())).alias("after"))
    ends = (
        found.where("edge = 'last'").select("part", "doc_id", "text", "fp").join(chain, "part")
        .join(firsts.withColumnRenamed("part", "after"), "after")
        .select("doc_id", "text", "fp", "following", "next_fp")
    )
    whole = found.where("edge IS NULL").unionAll(ends.mapInArrow(close, schema))
    return whole.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


_ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}


@lru_cache(maxsize=4096)
def tables(fixed: int = 0, radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The leading bits of every permuted table over the bits that ``fixed`` leaves
    open, as signed numbers."""
    positions = _open(fixed)
    cuts = [len(positions) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << p for p in positions[a:b]) for a, b in zip(cuts, cuts[1:])]
    found = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _open(fixed: int) -> list[int]:
    return [p for p in range(64) if not fixed >> p & 1]


def _fixed(path: tuple[int, ...]) -> int:
    return reduce(int.__or__, path, 0)


def _named(path: tuple[int, ...]) -> Column:
    """Name and fixed bits of the tables that lead to a bucket, outermost first."""
    return F.struct(F.lit(",".join(map(str, path))).alias("path"), F.lit(_fixed(path)).cast("long").alias("mask"))


def _first_here(bits: np.ndarray, path: list[int], radius: int) -> np.ndarray:
    """True where two fingerprints that differ in ``bits`` meet first on this path
    of tables, so that a pair counts once."""
    fixed, ok = 0, np.ones(len(bits), bool)
    for mask in path:
        for earlier in tables(fixed, radius):
            if earlier == mask:
                break
            ok &= bits & np.int64(earlier) != 0
        fixed |= mask
    return ok


def near_in_bucket(fps: np.ndarray, rows: np.ndarray, path: list[int], radius: int = RADIUS) -> np.ndarray:
    """For every fingerprint of a bucket the rows of the others within the radius
    that it meets first here."""
    near = np.zeros(len(fps), "int64")
    step = max(1, (1 << 20) // len(fps))
    for at in range(0, len(fps), step):
        bits = fps[at : at + step, None] ^ fps[None, :]
        a, b = np.nonzero((np.bitwise_count(bits.view("uint64")) <= radius) & (bits != 0))
        met = _first_here(bits[a, b], path, radius)
        np.add.at(near, a[met] + at, rows[b[met]])
    return near


def near_rows(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """fp and near: for every distinct fingerprint the number of rows of
    ``prints`` (fp) with another one within the radius; left out if there is none."""
    distinct = materialize(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "distinct_prints")
    paths, out = [(m,) for m in tables(0, radius)], []
    # every row becomes one per table, so few bytes are still much work
    wide = distinct.repartition(width_for(input_bytes(distinct), shuffle_width(distinct), WIDE_BYTES))
    rows = wide.select("fp", "n", F.inline(F.array(*map(_named, paths))))
    member = F.struct("fp", "n")

    def compare(batches):
        for batch in batches:
            fps, near = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
            found = batch.column(1)
            one, count = (c.to_numpy() for c in found.flatten().flatten())
            ends = np.cumsum(found.value_lengths().to_numpy())
            for path, start, end in zip(batch.column(0).to_pylist(), [0, *ends.tolist()], ends.tolist()):
                sums = near_in_bucket(one[start:end], count[start:end], [int(m) for m in path.split(",")], radius)
                fps.append(one[start:end][sums > 0])
                near.append(sums[sums > 0])
            yield pa.record_batch([pa.array(np.concatenate(fps)), pa.array(np.concatenate(near))], names=["fp", "near"])

    while True:
        last = all(len(_open(_fixed(p))) <= OPEN_BITS for p in paths)
        keyed = rows.select("fp", "n", "path", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = keyed.groupBy("path", "key").agg(
            F.count(F.lit(1)).alias("members"), F.min(member).alias("a"), F.max(member).alias("b")
        )
        apart = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
        sizes = materialize(sizes.where((F.col("members") > 2) | ((F.col("members") == 2) & (apart <= radius))), "table_sizes")
        out.append(sizes.where("members = 2").select("path", F.array("a", "b").alias("found")))
        more = sizes.where("members > 2").select("path", "key", "members")
        shared = keyed.join(F.broadcast(more) if fits_broadcast(more) else more, ["path", "key"])
        small = shared if last else shared.where(F.col("members") <= bucket)
        at = F.struct("path", "key").alias("at")
        lists = small.select(member.alias("m"), at).groupBy("at").agg(F.collect_list("m").alias("found"))
        out.append(lists.select("at.path", "found"))
        if last or not more.where(F.col("members") > bucket).head(1):
            break
        large = materialize(shared.where(F.col("members") > bucket).select("fp", "n", "path"), "large_tables")
        # at most as many paths as there are choices of blocks
        hot = [tuple(map(int, r["path"].split(","))) for r in large.select("path").distinct().collect()]
        finer = {p: [(*p, m) for m in tables(_fixed(p), radius)] for p in hot}
        spec = F.create_map(*[x for p, inner in finer.items() for x in (_named(p)["path"], F.array(*map(_named, inner)))])
        rows, paths = large.select("fp", "n", F.inline(F.element_at(spec, F.col("path")))), sum(finer.values(), [])
    found = reduce(DataFrame.unionAll, out).mapInArrow(compare, "fp long, near long")
    return found.groupBy("fp").agg(F.sum("near").alias("near"))


def near_documents(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and n_near: how many other rows of ``prints`` (fp) lie within the radius."""
    counts = prints.groupBy("fp").agg((F.count(F.lit(1)) - 1).alias("same"))
    joined = counts.join(near_rows(prints, radius), "fp", "left")
    return joined.select("fp", (F.col("same") + F.coalesce("near", F.lit(0))).alias("n_near"))
