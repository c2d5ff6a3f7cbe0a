"""Balanced label propagation: linked documents drift to common shards.

Documents with equal texts are linked.  Rows start in shards at random.  In every
round a linked row may move to the shard that holds most of its group, among the
shards with room for linked rows; where more rows want to enter than there is
room, a share of them goes, whole groups as long as they are small against a
shard.  Rounds end when no row wants to move.  Rows without links are only
fillers: at the end they, and linked rows only if there is no other, move from
too full shards to those with room, so that row counts differ by one at most
(law ``rows``).

A round is two grouped counts and two joins on (group, shard).  The driver sees
numbers by shard only.  Slots are numbered in groups that are small against a
shard, never in one task per shard.

Nulls and edges: a null text equals an empty one.  Repeated rows and null ids
are rows like any other; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.common import numbered
from labelloom.plans.joins import lookup_join
from labelloom.plans.scratch import materialize

SHARDS = 24
_STEPS = 1 << 20


def _share(*cols: str | Column) -> Column:
    """A number in [0, 1) that the columns decide."""
    return F.pmod(F.xxhash64(*cols), F.lit(_STEPS)) / _STEPS


def _by_shard(values: list, shard: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), shard + 1)


def _sums(rows: DataFrame, shards: int, amount: Column) -> list[int]:
    found = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum(amount).alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(members: DataFrame, capacity: int, shards: int = SHARDS) -> DataFrame:
    """rid, grp and shard of linked rows after label propagation.

    ``members`` has the rows of all groups of two or more and their first shard;
    ``capacity`` is the number of linked rows that a shard may take.
    """
    turn = 0
    while True:
        counts = materialize(members.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")), "group_shards")
        room = [max(0, capacity - n) for n in _sums(counts, shards, F.col("n"))]
        rank = F.struct("n", F.xxhash64("grp", "shard").alias("tie"), "shard")
        best = counts.groupBy("grp").agg(
            F.max(F.when(_by_shard(room, F.col("shard")) > 0, rank)).alias("to"), F.sum("n").alias("size")
        )
        here = F.when(_by_shard(room, F.col("shard")) > 0, rank < F.col("to")).otherwise(F.col("n") < F.col("to.n"))
        wishes = materialize(
            counts.join(best, "grp")
            .where(F.col("to").isNotNull() & here)
            .select("grp", "shard", "n", "size", F.col("to.shard").alias("to")),
            "wishes",
        )
        wanted = _sums(wishes.select(F.col("to").alias("shard"), "n"), shards, F.col("n"))
        if not sum(wanted):
            return members
        quota = [min(1.0, r / w) if w else 0.0 for r, w in zip(room, wanted, strict=True)]
        drawn = F.when(F.col("size") * 8 <= capacity, _share("grp", F.lit(turn))).otherwise(_share("rid", F.lit(turn)))
        goes = F.col("to").isNotNull() & (drawn < _by_shard(quota, F.col("to")))
        members = materialize(
            lookup_join(members, wishes.drop("n"), ["grp", "shard"], spread="rid", how="left").select(
                "rid", "grp", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard")
            ),
            "members",
        )
        turn += 1


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(text).alias("grp"),
        ),
        "rows",
    )
    total = rows.count()
    first = F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")
    groups = materialize(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("grp"), "groups")
    # a group of any size is spread over tasks
    linked = lookup_join(rows.select("rid", "grp"), groups, ["grp"], spread="rid")
    linked = materialize(linked.withColumn("shard", first), "members")
    moved = propagate(linked, total // shards, shards).select("rid", F.col("shard").alias("moved"))
    placed = materialize(
        rows.drop("grp").join(moved, "rid", "left").select(
            "rid", "doc_id", "size", "text_crc32",
            F.coalesce("moved", first).alias("shard"),
            # linked rows of a shard first, fillers after them
            (F.coalesce("moved", first) * 2 + F.col("moved").isNull().cast("int")).alias("queue"),
        ),
        "placed",
    )
    counts = {r["queue"]: r["n"] for r in placed.groupBy("queue").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = [counts.get(2 * s, 0) + counts.get(2 * s + 1, 0) for s in range(shards)]
    target = [total // shards + (s < total % shards) for s in range(shards)]
    over = [max(0, n - t) for n, t in zip(full, target, strict=True)]
    lack = [max(0, t - n) for n, t in zip(full, target, strict=True)]
    over_before = [0, *accumulate(over)][:-1]
    lack_before = [0, *accumulate(lack)]

    shard = F.col("shard")
    slot = F.col("number") + F.when(F.col("queue") % 2 == 1, _by_shard([counts.get(2 * s, 0) for s in range(shards)], shard)).otherwise(0)
    extra = F.col("slot") - _by_shard(target, shard) + _by_shard(over_before, shard)
    to = F.size(F.filter(F.array(*map(F.lit, lack_before[1:])), lambda end: end <= F.col("extra")))
    stays = F.col("slot") < _by_shard(target, shard)
    return (
        numbered(placed, "queue", counts, ["rid"])
        .withColumn("slot", slot)
        .withColumn("extra", F.when(~stays, extra))
        .withColumn("to", F.when(~stays, to))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.coalesce("to", "shard").cast("int").alias("shard"),
            F.when(stays, F.col("slot"))
            .otherwise(_by_shard(full, F.col("to")) + F.col("extra") - _by_shard(lack_before, F.col("to")))
            .cast("long")
            .alias("slot"),
        )
    )
