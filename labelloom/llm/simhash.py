"""Near duplicates by SimHash and covering locality-sensitive hashing.

Fingerprints within RADIUS bits are linked.  Every bit position gets a vector of
RADIUS + 1 bits, and every non-zero vector v of that length a mask: the positions
whose vector has an odd product with v.  RADIUS positions span less than the
whole space, so some v is orthogonal to all of them and its mask holds none: any
two fingerprints within the radius agree on at least one of the
2**(RADIUS + 1) - 1 masks, and no link is missed.

Only distinct fingerprints take part, so exact copies cost one row.  A bucket of
up to BUCKET fingerprints is compared at once in one row.  The fingerprints of a
larger bucket are dealt again by the same construction on the bits that its mask
leaves open; after two such steps at most 2**OPEN_BITS fingerprints can share a
bucket, whatever the data.  A bucket yields a spanning forest of its links, never
all pairs.

Nulls and edges: a null or empty text has fingerprint zero, a text of fewer than
SHINGLE words one shingle of all its words.  A row without doc_id gets the
component of its fingerprint like any other and never names one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from labelloom.llm.graph import components
from labelloom.plans.joins import fits_broadcast
from labelloom.plans.scratch import materialize

SHINGLE = 4
SEED = 42
RADIUS = 4
BUCKET = 4096
OPEN_BITS = 16
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of all shingles; bytes.split takes exactly ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "uint64")
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "uint64")
    lengths = np.fromiter(map(len, words), "int64", len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    hashed = (
        xxhash.xxh64_intdigest(joined[a:b], SEED)
        for a, b in zip(starts[: len(words) - size + 1].tolist(), (starts[size:] - 1).tolist(), strict=True)
    )
    return np.fromiter(hashed, "uint64", len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, "int64")
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK].astype(">u8"))
        ones += np.unpackbits(part.view("uint8").reshape(-1, 8), axis=1).sum(0, dtype="int64")
    bits = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``fp`` beside the columns of ``docs``, whose text comes last and goes."""
    names = docs.columns[:-1]
    kept = docs.select(*names).schema

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t)) for t in batch.column(len(names)).to_pylist()]
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(fps, pa.int64())], names=[*names, "fp"])

    return docs.mapInArrow(run, kept.add("fp", "long"))


def masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """The covering masks over the given bit positions, as signed numbers.

    Position i has the vector i mod (2**(radius+1) - 1) + 1, so vectors are
    spread evenly and none is zero."""
    size = (1 << (radius + 1)) - 1
    found = []
    for v in range(1, size + 1):
        mask = sum(1 << p for i, p in enumerate(positions) if ((i % size + 1) & v).bit_count() % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def _open(mask: int) -> list[int]:
    return [p for p in range(64) if not mask >> p & 1]


def _dealt_again(rows: DataFrame, outer: list[int], refine: Callable) -> tuple[DataFrame, list[int]]:
    """Rows of large buckets under masks refined by the bits their mask leaves open."""
    finer = {m: [m | x for x in refine(_open(m))] for m in outer}
    spec = F.create_map(*[x for m, inner in finer.items() for x in (F.lit(m), F.array(*map(F.lit, inner)))])
    rows = rows.select("fp", F.explode(F.element_at(spec, F.col("mask"))).alias("mask"))
    return rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))), sorted({x for v in finer.values() for x in v})


def buckets(fps: DataFrame, first: list[int], refine: Callable, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Buckets that may hold a pair within the radius: at (mask, key), fps.

    ``first`` are masks such that fingerprints to be compared agree on one of
    them, and ``refine`` gives such masks over the bits that one leaves open.
    Buckets of two are known from their least and greatest member; only those of
    more are joined with their members again.
    """
    keys = F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(m).alias("key")) for m in first])
    rows, outer, out = fps.select("fp", F.inline(keys)), first, []
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    at = F.struct("mask", "key").alias("at")
    while True:
        last = all(len(_open(m)) <= OPEN_BITS for m in outer)
        sizes = rows.groupBy("mask", "key").agg(
            F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
        )
        sizes = materialize(sizes.where((F.col("n") > 2) | ((F.col("n") == 2) & near)), "bucket_sizes")
        out.append(sizes.where("n = 2").select(at, F.array("a", "b").alias("fps")))
        more = sizes.where("n > 2").select("mask", "key", "n")
        shared = rows.join(F.broadcast(more) if fits_broadcast(more) else more, ["mask", "key"])
        small = shared if last else shared.where(F.col("n") <= bucket)
        # a key of its own, so that Spark may split the skewed join before it
        out.append(small.select("fp", at).groupBy("at").agg(F.collect_list("fp").alias("fps")))
        if last or not more.where(F.col("n") > bucket).head(1):
            break
        large = materialize(shared.where(F.col("n") > bucket).select("fp", "mask"), "large_buckets")
        hot = [r["mask"] for r in large.select("mask").distinct().collect()]
        rows, outer = _dealt_again(large, hot, refine)
    return reduce(DataFrame.unionAll, out)


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints."""
    links, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            # the count of a signed number would be that of its absolute value
            near = np.bitwise_count((rest ^ queue[-1]).view("uint64")) <= radius
            one, found = int(queue.pop()), rest[near]
            links += [(one, int(x)) for x in found]
            queue += list(found)
            rest = rest[~near]
    return links


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links a, b whose components are those of all pairs within the radius.

    ``fps`` holds distinct fingerprints in a column ``fp``."""

    def compare(batches):
        for batch in batches:
            found = []
            lists = batch.column(0)
            values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            for one in np.split(values, ends[:-1]):
                # in one order under every mask, so that masks repeat links
                found += forest(np.sort(one), radius)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def covering(positions):
        return masks(positions, radius)

    found = buckets(fps, covering(list(range(64))), covering, radius, bucket)
    return found.select("fps").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (doc_id, text)."""
    prints = materialize(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    joined = distinct.join(roots, distinct["fp"] == roots["vertex"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    firsts = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(joined.join(firsts, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
