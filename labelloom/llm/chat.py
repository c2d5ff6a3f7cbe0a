"""Preference formatting of chosen and rejected conversations.

The two conversations of a pair are compared turn by turn.  Their longest common
prefix of turns is rendered once as the prompt; what follows it on either side
is that side's completion.  Loss masks are 1 on assistant turns of a completion
and 0 elsewhere.  The result has one row per rendered turn, so a conversation of
any length is spread over tasks and never gathered.

Nulls and edges: turns without conversation or number belong nowhere and are
ignored.  Several rows for one turn count as one, the smallest (role, text).  A
null role is ``unknown``, a null text is empty.  Two equal conversations have
only a prompt; a pair without a common first turn has an empty prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.plans.joins import lookup_join
from labelloom.plans.scratch import materialize

PROMPT, CHOSEN, REJECTED = "prompt", "chosen", "rejected"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: one row per turn."""
    return (
        conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .groupBy("conv_id", "turn")
        .agg(
            F.min(
                F.struct(
                    F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
                )
            ).alias("m")
        )
        .select("conv_id", "turn", "m.role", "m.text")
    )


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rendered turns of every pair.

    Both inputs hold pair_id, turn, role and text, one row per turn.  Returns
    pair_id, part (prompt, chosen or rejected), turn, role, content and mask.
    """
    both = chosen.select("pair_id", "turn", F.struct("role", "text").alias("c"), F.lit(None).alias("r")).unionByName(
        rejected.select("pair_id", "turn", F.lit(None).alias("c"), F.struct("role", "text").alias("r"))
    )
    aligned = materialize(both.groupBy("pair_id", "turn").agg(F.min("c").alias("c"), F.min("r").alias("r")), "aligned_turns")
    split = (
        aligned.where(~F.col("c").eqNullSafe(F.col("r")))
        .groupBy("pair_id")
        .agg(F.min("turn").alias("first"))
    )
    sides = F.when(
        F.col("first").isNull() | (F.col("turn") < F.col("first")),
        F.array(F.struct(F.lit(PROMPT).alias("part"), F.col("c").alias("m"))),
    ).otherwise(
        F.array(
            F.struct(F.lit(CHOSEN).alias("part"), F.col("c").alias("m")),
            F.struct(F.lit(REJECTED).alias("part"), F.col("r").alias("m")),
        )
    )
    rows = lookup_join(aligned, materialize(split, "first_differences"), ["pair_id"], spread="turn", how="left").select("pair_id", "turn", F.inline(sides)).where("m IS NOT NULL")
    return rows.select(
        "pair_id",
        "part",
        "turn",
        F.col("m.role").alias("role"),
        render_turn(F.col("m.role"), F.col("m.text")).alias("content"),
        ((F.col("part") != PROMPT) & (F.col("m.role") == "assistant")).cast("int").alias("mask"),
    )


def shared_start_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns made from one table of conversations.

    Of the conversations with an equal first turn, the one of the smallest
    conv_id is chosen and every other one is rejected against it.  A
    conversation that shares its first turn with no other is chosen against
    itself with its last assistant reply cut to the first half; without an
    assistant turn it makes no pair.  ``pair_id`` is the rejected conv_id.
    """
    talk = materialize(turns(conversations), "turns")
    marks = materialize(
        talk.groupBy("conv_id").agg(
            F.min(F.struct("turn", F.sha2(F.concat_ws("\n", "role", "text"), 256).alias("key")))["key"].alias("key"),
            F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("reply"),
        ),
        "first_turns",
    )
    starts = materialize(marks.groupBy("key").agg(F.min("conv_id").alias("best"), F.count(F.lit(1)).alias("n")), "starts")
    # a first turn that many conversations share, and one chosen against many, are spread over tasks
    pairs = lookup_join(marks, starts, ["key"], spread="conv_id").where(
        ((F.col("n") > 1) & (F.col("conv_id") != F.col("best"))) | ((F.col("n") == 1) & F.col("reply").isNotNull())
    )
    pairs = materialize(
        pairs.select(F.col("conv_id").alias("pair_id"), "best", "reply", (F.col("n") == 1).alias("alone")), "pairs"
    )
    chosen = lookup_join(pairs.select("pair_id", F.col("best").alias("conv_id")), talk, ["conv_id"], spread="pair_id")
    other = lookup_join(talk, pairs.withColumn("conv_id", F.col("pair_id")), ["conv_id"], spread="turn")
    cut = F.when(
        F.col("alone") & (F.col("turn") == F.col("reply")),
        F.substring(F.col("text"), F.lit(1), (F.length("text") / 2).cast("int")),
    ).otherwise(F.col("text"))
    return (
        chosen.select("pair_id", "turn", "role", "text"),
        other.select("pair_id", "turn", "role", cut.alias("text")),
    )
