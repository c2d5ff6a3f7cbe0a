"""Packing of tokenised documents into sequences by shortest-pack-first.

A document longer than a sequence is cut into whole sequences and a rest.  The
pieces are counted by length; that histogram has at most ``capacity`` rows, so
it is packed on the driver whatever the size of the corpus: lengths are placed
longest first, each into the packs with the most room left, and equal packs are
one pattern with a count.  Pieces are then numbered within their length and
joined to the places of the patterns by that number.

Numbering is split: a length is dealt to as many groups as its share of the
pieces asks for, pieces are numbered within a group and groups are offset by
their counts, so a length that a third of all documents share is no single task.

Nulls and edges: a null text is an empty one, whose only id is the end mark.
Every row is a document of its own, repeated rows and null ids included.
"""

from __future__ import annotations

import array
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelloom.llm.common import numbered
from labelloom.plans.scratch import materialize

CAPACITY = 4096
END = 2
#: Words whose ids a worker remembers; when full, it starts anew.
REMEMBERED = 400_000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLAIN = re.compile("([a-zß-öø-ÿ]*)([!-&*-/:-@|]*)")


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the other bytes for 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordIds(dict):
    """Word (UTF-8) -> its ids as little-endian 32-bit bytes.

    The tokenizer drops white space and lets no token cross it, so the ids of a
    text are those of its words.  Words of Latin letters, with or without marks
    at their end, go to the vocabulary model directly, all others through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = b"<|"

    def text(self, text: str) -> bytes:
        raw = text.encode()
        if self.special in raw:  # marks such as <|endoftext|> are told by their case
            return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, raw.lower().split()))

    def __missing__(self, word: bytes) -> bytes:
        found = _PLAIN.fullmatch(text) if len(text := word.decode()) < 60 else None
        if found and found[1] and found[2]:
            ids = self[found[1].encode()] + self[found[2].encode()]
        elif found and found[1]:
            ids = _pack([x.id for x in self.model.tokenize("".join(map(self.letters.__getitem__, word)))])
        else:
            ids = _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self[word] = ids
        return ids


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_words: dict[str, WordIds] = {}


def _worker_words(path: str) -> WordIds:
    """The word ids of this Python worker."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece."""

    def cut(batches):
        words = _worker_words(path)
        mark = _pack([end])
        for batch in batches:
            out = tuple(array.array("q") for _ in range(4))
            rows = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = words.text(text or "") + mark
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    size = min(capacity, n - at)
                    rows.append(row)
                    for column, v in zip(out, (at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n), strict=True):
                        column.append(v)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(np.frombuffer(c, "q")) for c in out]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Patterns (how often each length stands in a sequence) and their counts.

    Lengths are placed longest first into the packs with the most room.  Pieces
    that fit nowhere open packs of as many of them as fit.
    """
    open_packs: dict[int, list[tuple[Counter, int]]] = {}  # by room left
    done: list[tuple[Counter, int]] = []

    def put(pattern: Counter, room: int, n: int) -> None:
        if n:
            (open_packs.setdefault(room, []) if room else done).append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max(open_packs, default=0)
            if room < length:
                fit = capacity // length
                put(Counter({length: fit}), capacity - fit * length, left // fit)
                if left % fit:
                    put(Counter({length: left % fit}), capacity - left % fit * length, 1)
                break
            pattern, n = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
            used = min(n, left)
            put(pattern, room, n - used)
            put(pattern + Counter({length: 1}), room - length, used)
            left -= used
    return done + [x for room in sorted(open_packs) for x in open_packs[room]]


def places(patterns: list[tuple[Counter, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (length << 44 | first number) and, for each, the first number,
    the first sequence, pieces a sequence and offset of the first piece."""
    rows, first, taken = [], 0, Counter()
    for pattern, n in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            times = pattern[length]
            rows.append((length << 44 | taken[length], taken[length], first, times, offset))
            taken[length] += n * times
            offset += length * times
        first += n
    found = np.array(sorted(rows), "int64").reshape(-1, 5)
    return found[:, 0], found[:, 1:]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``pieces`` with the sequence_id and offset of each."""
    cut = materialize(pieces(docs, path, capacity, end), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = docs.sparkSession
    keys, values = places(pack_histogram(counts, capacity))
    shared = spark.sparkContext.broadcast((keys, values))

    def place(batches):
        keys, values = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            first, sequence, times, offset = values[np.searchsorted(keys, length << 44 | number, "right") - 1].T
            q = number - first
            yield pa.record_batch(
                [*batch.columns[:5], pa.array(sequence + q // times), pa.array(offset + q % times * length)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = numbered(cut, "length", counts, ["doc_id", "start", "ids_crc32"]).select(*columns, "number")
    return rows.mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")
