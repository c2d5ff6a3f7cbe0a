"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q that is at least
max(LEAST, 2q) words long and that no neighbouring word extends.  At scale L = 1,
2, 4, ... a text is cut into blocks of L words, and periods 2L-1 to 4L-2 are
searched: the first period of such a run holds a whole block, and the block comes
again exactly q words later.  The sum of squared differences between a block and
every stretch of its following window is one convolution, computed exactly modulo
PRIME by number-theoretic transforms of many blocks at once.  A sum other than
zero proves a mismatch; where it is zero, the distance is a seed: the words are
compared, and the agreement is extended to both sides as far as it goes.  Seeds
inside a run already found, at a multiple of its period, tell nothing new and are
left out.  A word that does not come again within the window rules its block out
before the transform.

Every text is worked on by itself, in memory proportional to its length, so the
step is one scan without a shuffle.

Nulls and edges: a null, empty or blank text has no words, no runs and an empty
collapsed text.  Every row is a text of its own, repeated rows and null ids
included; an empty table gives an empty table.  Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST = 12
#: 3 * 2**30 + 1 with generator 5: transforms of up to 2**30 values, and products
#: of two residues fit in 64 bits.
PRIME = 3 * (1 << 30) + 1
GENERATOR = 5
#: Values that one batch of transforms holds, if a single block needs no more.
BATCH = 1 << 18

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@lru_cache(maxsize=64)
def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order ``size``."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(1, "uint64")
    while len(out) < size // 2:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % np.uint64(PRIME)])
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Transform of every row (a power of two of residues), in bit-reversed order."""
    p, size = np.uint64(PRIME), rows.shape[1]
    while size > 1:
        parts = rows.reshape(len(rows), -1, size)
        low, high = parts[..., : size // 2], parts[..., size // 2 :]
        rows = np.concatenate([(low + high) % p, (low + p - high) % p * _powers(size, False) % p], axis=2)
        rows, size = rows.reshape(len(rows), -1), size // 2
    return rows


def restore(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``transform``."""
    p, width, size = np.uint64(PRIME), rows.shape[1], 2
    while size <= width:
        parts = rows.reshape(len(rows), -1, size)
        low, high = parts[..., : size // 2], parts[..., size // 2 :] * _powers(size, True) % p
        rows = np.concatenate([(low + high) % p, (low + p - high) % p], axis=2).reshape(len(rows), -1)
        size *= 2
    return rows * np.uint64(pow(width, -1, PRIME)) % p


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo PRIME, between row i of ``blocks`` (L
    values, a power of two) and every stretch of row i of ``windows`` (3L - 1)."""
    count, length = blocks.shape
    p = np.uint64(PRIME)
    width = 4 * length
    left, right = np.zeros((count, width), "uint64"), np.zeros((count, width), "uint64")
    left[:, 0], left[:, width - length + 1 :] = blocks[:, 0], blocks[:, :0:-1]
    right[:, : 3 * length - 1] = windows
    products = restore(transform(left) * transform(right) % p)[:, : 2 * length]
    squares = np.zeros((count, 3 * length), "uint64")
    # a prefix of fewer than 2**32 residues fits in 64 bits
    np.cumsum(windows * windows % p, axis=1, out=squares[:, 1:])
    around = (squares[:, length:] - squares[:, : 2 * length]) % p
    own = (blocks * blocks % p).sum(1, keepdims=True) % p
    return (own + around + np.uint64(2) * (p - products)) % p


def _next_distance(ids: np.ndarray) -> np.ndarray:
    """How many words later the same word comes again; far beyond the text if never."""
    order = np.argsort(ids, kind="stable")
    again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    out = np.full(len(ids), np.iinfo("int64").max)
    out[order[again]] = order[again + 1] - order[again]
    return out


def _seeds(ids: np.ndarray, padded: np.ndarray, gaps: np.ndarray, length: int) -> np.ndarray:
    """(position, distance) of the blocks of ``length`` words that come again, by position."""
    found = [np.zeros((0, 2), "int64")]
    near = (gaps[: len(ids) // length * length].reshape(-1, length) <= 4 * length - 2).all(1)
    starts = np.flatnonzero(near) * length
    step = max(1, BATCH // (4 * length))
    for first in range(0, len(starts), step):
        part = starts[first : first + step]
        blocks = ids[part[:, None] + np.arange(length)]
        windows = padded[part[:, None] + np.arange(2 * length - 1, 5 * length - 2)]
        row, at = np.nonzero(mismatches(blocks, windows) == 0)
        found.append(np.stack([part[row], at + 2 * length - 1], 1))
    return np.concatenate(found)


def _agreement(ids: np.ndarray, at: int, end: int, distance: int) -> tuple[int, int]:
    """The longest stretch around at..end whose words equal those ``distance`` later."""
    step, limit = 16, len(ids) - distance
    while end < limit:
        stop = min(end + step, limit)
        differs = ids[end:stop] != ids[end + distance : stop + distance]
        if differs.any():
            end += int(differs.argmax())
            break
        end, step = stop, 2 * step
    step = 16
    while at > 0:
        stop = max(at - step, 0)
        differs = (ids[stop:at] != ids[stop + distance : at + distance])[::-1]
        if differs.any():
            at -= int(differs.argmax())
            break
        at, step = stop, 2 * step
    return at, end


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers from 1 on."""
    n, found, length = len(ids), {}, 1
    if n < least:
        return []
    ids = ids.astype("uint64")
    gaps = _next_distance(ids)
    while 2 * (2 * length - 1) <= n:
        if (gaps <= 4 * length - 2).sum() >= length:
            padded = np.concatenate([ids, np.zeros(5 * length, "uint64")])
            seeds = _seeds(ids, padded, gaps, length)
            new = seeds[:, 1] <= n // 2
            for (start, end), period in found.items():
                if end - start >= 3 * length - 1:
                    a, b = np.searchsorted(seeds[:, 0], [start, end])
                    inside = seeds[a:b].sum(1) + length <= end
                    new[a:b] &= ~(inside & (seeds[a:b, 1] % period == 0))
            seeds = seeds[new]
            seeds = seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]
            known, low, high = 0, 0, 0
            for at, distance in seeds.tolist():
                if distance == known and low <= at and at + length <= high:
                    continue
                if (ids[at : at + length] != padded[at + distance : at + length + distance]).any():
                    continue  # equal sums modulo PRIME only
                known, (low, high) = distance, _agreement(ids, at, at + length, distance)
                # a shorter period of the same stretch was found before
                if high + distance - low >= max(least, 2 * distance):
                    found.setdefault((low, high + distance), distance)
        length *= 2
    return sorted((start, end - start, period) for (start, end), period in found.items())


def collapse(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``count`` words no run holds after its first period."""
    edges = np.zeros(count + 1, "int64")
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, ``runs`` by start and period, and the ``collapsed`` text of every
    row of ``docs`` (doc_id, text): its words without later periods of any run,
    joined by one space."""
    names = ["doc_id", "runs", "collapsed"]

    def find(batches):
        for batch in batches:
            counts, flat, texts = [0], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words, number = (text or b"").split(), {}
                ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), "int64", len(words))
                found = runs_of(ids, least)
                counts.append(counts[-1] + len(found))
                flat += found
                if found:
                    words = [words[i] for i in np.flatnonzero(collapse(len(words), found)).tolist()]
                texts.append(b" ".join(words))
            table = np.array(flat, "int64").reshape(-1, 3)
            rows = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(c)) for c in table.T], names=["start", "length", "period"]
            )
            lists = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), rows)
            yield pa.record_batch(
                [batch.column(0), lists, pa.array(texts, pa.binary()).cast(pa.string(), safe=False)], names=names
            )

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = source.select("doc_id", F.lit(None).cast(_RUNS).alias("runs"), F.lit("").alias("collapsed")).schema
    return source.mapInArrow(find, schema)
