"""Repair of conversations whose turns were lost, emptied, repeated or mislabelled.

A good conversation is an optional system turn and then pairs of user and
assistant turns.  The cheapest edits that give one are a shortest path through
four states (nothing yet, after system, after user, after assistant); among the
cheapest, the edits whose initials are least in ASCII order are taken.  The path
is found by divide and conquer: the forward vector of a first half (cost of every
state, and the order of the least audits that lead there) meets the backward cost
vector of the second half, the least-audit state among the cheapest crossings is
chosen, and both halves are solved on their own, in linear space.

The same division spreads a conversation over tasks.  All rows are sorted once by
conversation and turn and cut into segments of at most 2**SEGMENT_BITS rows; a
segment becomes one 4 x 4 table of costs and orders, tables of neighbours are
multiplied into tables of longer stretches, and crossings are chosen top-down
until every segment knows the states at its ends.  A conversation with a third of
all rows is as many segments as its size asks for.  Equal rows are recognised by a
grouped minimum, so copies are combined before the shuffle.

Nulls and edges: a null role or text is one space, rows without turn come first,
equal turns in the order of role and text.  Rows without conv_id are one
conversation.  Repeated rows are duplicates.  A conversation always has a repair,
since all its rows may be deleted; an empty table gives empty tables.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from labelloom.llm.common import SPACES
from labelloom.plans.joins import lookup_join
from labelloom.plans.scratch import materialize

REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: Rows of one segment, and stretches that one task multiplies, as powers of two.
SEGMENT_BITS = 14
FAN_BITS = 12

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: State after an inserted or rerolled turn, and what is inserted to end well.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: A row is a letter: its initial (s, u, a, other) and fault (none, to delete, truncated).
INITIALS, FAULTS = "sua", 3


def _letter(initial: Column, delete: Column, truncated: Column) -> Column:
    kind = F.lit(len(INITIALS))
    for i, known in enumerate(INITIALS):
        kind = F.when(initial == known, i).otherwise(kind)
    fault = F.when(delete, 1).when(truncated, 2).otherwise(0)
    return F.char(F.ascii(F.lit("A")) + kind * FAULTS + fault)


def _initial(letter: str) -> str:
    return (INITIALS + "-")[(ord(letter) - ord("A")) // FAULTS]


@lru_cache(maxsize=None)
def ways(letter: str) -> tuple:
    """[from][to]: cost and audit of the best way through one row, or None."""
    initial, fault = _initial(letter), (ord(letter) - ord("A")) % FAULTS
    late = UNFINISHED if fault == 2 else 0
    out = []
    for state in STATES:
        best, at, inserted = [None] * len(STATES), state, ""
        for _ in range(3):
            found = [(at, DELETE, "D")]
            if fault != 1:
                found.append((NEXT[at], REROLE + late, "R"))
                if initial == "s" and at == START:
                    found.append((SYSTEM, late, "K"))
                elif ROLES[NEXT[at]][0] == initial:
                    found.append((NEXT[at], late, "K"))
            for to, cost, edit in found:
                way = (cost + INSERT * len(inserted), inserted + edit)
                best[to] = min(best[to] or way, way)
            at, inserted = NEXT[at], inserted + "I"
        out.append(tuple(best))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def _table(part) -> tuple:
    """[from][to]: cost and order among the ways from there, of a row or a stretch."""
    if not isinstance(part, str):
        return part
    out = []
    for row in ways(part):
        audits = sorted(w[1] for w in row if w)
        out.append(tuple(w and (w[0], audits.index(w[1])) for w in row))
    return tuple(out)


def unit(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in STATES)


@lru_cache(maxsize=1 << 16)
def _forward(vector: tuple, part) -> tuple[tuple, int]:
    """Vector of (cost, order of the least audit) after one more part, and the
    least cost that was taken off.

    The audits that lead to the states end with a row, so none begins another
    one, and two of different states compare by their order alone."""
    table, best = _table(part), [None] * len(STATES)
    for seen, row in zip(vector, table):
        for to, way in enumerate(row):
            if seen and way:
                found = (seen[0] + way[0], seen[1], way[1])
                best[to] = min(best[to] or found, found)
    least = min(b[0] for b in best if b)
    order = sorted(b[1:] for b in best if b)
    return tuple(b and (b[0] - least, order.index(b[1:])) for b in best), least


@lru_cache(maxsize=1 << 16)
def _backward(vector: tuple, part) -> tuple[tuple, int]:
    """Cost of every state before one more part at the front, and what was taken off."""
    best = [
        min((way[0] + rest for way, rest in zip(row, vector) if way and rest is not None), default=None)
        for row in _table(part)
    ]
    least = min(b for b in best if b is not None)
    return tuple(b and b - least if b is not None else None for b in best), least


def _after(parts, low: int, high: int, vector: tuple) -> tuple[tuple, int]:
    total = 0
    for i in range(low, high):
        vector, more = _forward(vector, parts[i])
        total += more
    return vector, total


def product(parts) -> tuple:
    """The table of a whole stretch."""
    out = []
    for state in STATES:
        vector, total = _after(parts, 0, len(parts), unit(state))
        out.append(tuple(v and (v[0] + total, v[1]) for v in vector))
    return tuple(out)


def _end(state: int | None) -> tuple:
    if state is None:
        return tuple(INSERT * len(TAIL[s]) for s in STATES)
    return tuple(0 if s == state else None for s in STATES)


def crossings(parts, start: int, end: int | None) -> list[int]:
    """The state before every part and after the last one, on the best way from
    ``start`` to ``end`` (None: to a good end of the conversation)."""
    states = [start] + [end] * len(parts)
    todo = [(0, len(parts))]
    while todo:
        low, high = todo.pop()
        if high - low == 1 and states[high] is not None:
            continue
        middle = max(low + 1, (low + high) // 2)
        vector, _ = _after(parts, low, middle, unit(states[low]))
        rest = _end(states[high])
        for i in range(high - 1, middle - 1, -1):
            rest, _ = _backward(rest, parts[i])
        meet = [(v[0] + r, v[1], s) for s, (v, r) in enumerate(zip(vector, rest)) if v and r is not None]
        states[middle] = min(meet)[2]
        todo += [(low, middle), (middle, high)] if middle < high else []
    return states


def edits(letters: str, start: int = START, end: int | None = None) -> list[str]:
    """The audit of every row, inserts before it included; the last one's may
    have inserts after it."""
    states = crossings(letters, start, end)
    out = [ways(x)[a][b][1] for x, a, b in zip(letters, states, states[1:])]
    if out and end is None:
        out[-1] += TAIL[states[-1]]
    return out


def new_roles(letters: str, audit: list[str], start: int = START) -> list[str]:
    """For every edit of ``audit`` the initial of the role it sets, - for none."""
    out, state = [], start
    for letter, row in zip(letters, audit):
        roles = ""
        for edit in row:
            if edit in "IR":
                state = NEXT[state]
            elif edit == "K":
                state = 1 + INITIALS.index(_initial(letter))
            roles += ROLES[state][0] if edit in "IR" else "-"
        out.append(roles)
    return out


def _illegal(letters: str) -> int:
    pairs = (_initial(a) + _initial(b) for a, b in zip(letters, letters[1:]))
    return sum(p not in ("su", "ua", "au") for p in pairs)


_SEGMENT = "conv_id {0}, seg long, costs array<long>, orders array<long>, ends string, illegal long"


def _flat(table: tuple) -> tuple[list, list]:
    ways = [w or (None, None) for row in table for w in row]
    return [w[0] for w in ways], [w[1] for w in ways]


def _unflat(costs: list, orders: list) -> tuple:
    flat = [None if c is None else (c, o) for c, o in zip(costs, orders)]
    return tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4))


def _mapped(df: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """``work`` (one row's values -> tuples) over Arrow batches."""
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            rows = [out for row in zip(*[c.to_pylist() for c in batch.columns]) for out in work(*row)]
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), wanted)]
                yield pa.record_batch(columns, schema=wanted)

    return df.select(*columns).mapInArrow(run, schema)


def _stretches(nodes: DataFrame, *by: Column) -> DataFrame:
    child = F.struct("seg", "costs", "orders", "ends", "illegal")
    return nodes.groupBy("conv_id", *by).agg(F.sort_array(F.collect_list(child)).alias("children"))


def _tables_of(children: list[dict]) -> list[tuple]:
    return [_unflat(c["costs"], c["orders"]) for c in children]


def _joined(children: list[dict]) -> tuple[str, int]:
    """First and last letter of neighbouring stretches, and their illegal turns."""
    seams = sum(_illegal(a["ends"][-1] + b["ends"][0]) for a, b in zip(children, children[1:]))
    return children[0]["ends"][0] + children[-1]["ends"][-1], seams + sum(c["illegal"] for c in children)


def _chosen(children: list[dict], start: int, end: int) -> list[tuple]:
    states = crossings(_tables_of(children), start, None if end < 0 else end)
    return [
        (c["seg"], a, -1 if end < 0 and i == len(children) - 1 else b)
        for i, (c, a, b) in enumerate(zip(children, states, states[1:]))
    ]


def _sorted_rows(conversations: DataFrame) -> DataFrame:
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("text", "role"))
    rows = conversations.select("conv_id", "turn", role, text)
    inked = F.rtrim("text", F.lit(SPACES))
    rows = rows.select(
        "*",
        (inked == "").alias("blank"),
        (~F.substring(inked, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.unhex(F.sha2(F.to_json(F.struct("conv_id", "role", "text")), 256)).alias("digest"),
        # equal rows may stand in any order, the number only lets ranges split them
        F.monotonically_increasing_id().alias("_row"),
    )
    ordered = rows.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "text", "_row").drop("_row")
    return materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "turns_in_order")


def repair(
    conversations: DataFrame, segment_bits: int = SEGMENT_BITS, fan_bits: int = FAN_BITS
) -> tuple[DataFrame, DataFrame]:
    """Summaries and repaired turns of ``conversations`` (conv_id, turn, role, text).

    Summaries: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    Turns: conv_id, at, place, edit, role, text in the order of (at, place);
    inserted turns have the edit I, deleted ones are left out.
    """
    rows = _sorted_rows(conversations)
    copies = rows.where("NOT blank").groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = materialize(copies.where("n > 1").drop("n"), "repeated_turns")
    small = rows.select("conv_id", "at", "blank", "truncated", "digest", F.substring("role", 1, 1).alias("initial"))
    marked = lookup_join(small, copies, ["digest"], "at", "left").select(
        "conv_id", "at", "blank", "truncated", "initial", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("again")
    )
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("truncated"), 3)
    letter = _letter(F.col("initial"), F.col("blank") | F.col("again"), F.col("truncated"))
    count = lambda k, name: F.count(F.when(fault == k, 1)).alias(name)
    segments = materialize(
        marked.groupBy("conv_id", F.shiftright("at", segment_bits).alias("seg"))
        .agg(
            F.sort_array(F.collect_list(F.struct("at", letter.alias("letter")))).alias("rows"),
            count(1, "blank"), count(2, "duplicate"), count(3, "truncated"),
        )
        .withColumn("seg", F.col("rows")[0]["at"])
        .withColumn("letters", F.array_join("rows.letter", "")),
        "segments",
    )

    conv_type = rows.schema["conv_id"].dataType.simpleString()
    schema = _SEGMENT.format(conv_type)

    def node(conv, seg, letters):
        yield conv, seg, *_flat(product(letters)), letters[0] + letters[-1], _illegal(letters)

    def multiplied(conv, children):
        yield conv, children[0]["seg"], *_flat(product(_tables_of(children))), *_joined(children)

    nodes, levels, shift = _mapped(segments, ["conv_id", "seg", "letters"], schema, node), [], segment_bits
    while True:
        nodes = materialize(nodes, "stretches")
        widest = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if widest <= 1 << fan_bits:
            break
        shift = min(shift + fan_bits, 63)
        levels.append(materialize(_stretches(nodes, F.shiftright("seg", shift)).select("conv_id", "children"), "level"))
        nodes = _mapped(levels[-1], ["conv_id", "children"], schema, multiplied)
    top = materialize(_stretches(nodes), "conversations")

    def total(conv, children):
        vector, cost = _after(_tables_of(children), 0, len(children), unit(START))
        cost += min(v[0] + INSERT * len(TAIL[s]) for s, v in enumerate(vector) if v)
        yield conv, cost, _joined(children)[1]

    totals = _mapped(top, ["conv_id", "children"], f"conv_id {conv_type}, cost long, illegal long", total)
    ends = "seg long, start long, end long"
    states = _mapped(top, ["children"], ends, lambda children: _chosen(children, START, -1))
    for level in reversed(levels):
        known = level.withColumn("seg", F.col("children")[0]["seg"]).join(states, "seg")
        states = materialize(_mapped(known, ["children", "start", "end"], ends, _chosen), "states")

    def audited(conv, seg, rows, letters, start, end):
        audit = edits(letters, start, None if end < 0 else end)
        yield conv, seg, [r["at"] for r in rows], audit, new_roles(letters, audit, start)

    audits = _mapped(
        segments.join(states, "seg"), ["conv_id", "seg", "rows", "letters", "start", "end"],
        f"conv_id {conv_type}, seg long, ats array<long>, edits array<string>, roles array<string>", audited,
    )
    audits = materialize(audits, "audits")
    return _summaries(rows, segments, totals, audits), _turns(rows, audits)


def _summaries(rows: DataFrame, segments: DataFrame, totals: DataFrame, audits: DataFrame) -> DataFrame:
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = segments.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    audit = F.sort_array(F.collect_list(F.struct("seg", F.array_join("edits", "").alias("audit"))))
    parts = [
        rows.groupBy("conv_id").agg(gaps.alias("gaps")),
        counts,
        totals,
        audits.groupBy("conv_id").agg(audit.alias("a")).select("conv_id", F.array_join("a.audit", "").alias("audit")),
    ]
    out = parts[0]
    for part in parts[1:]:
        part = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(part, out["conv_id"].eqNullSafe(part["_conv"])).drop("_conv")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    each = audits.select(F.inline(F.arrays_zip("ats", "edits", "roles"))).withColumnRenamed("ats", "at")
    places = F.inline(
        F.transform(
            F.split("edits", ""),
            lambda edit, i: F.struct(i.alias("place"), edit.alias("edit"), F.substring(F.col("roles"), i + 1, F.lit(1)).alias("set")),
        )
    )
    new = F.when(F.col("set") == "u", ROLES[USER]).when(F.col("set") == "a", ROLES[ASSISTANT]).otherwise(F.col("role"))
    text = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    done = rows.select("conv_id", "at", "role", "text").join(each, "at").select("conv_id", "at", "role", "text", places)
    return done.where("edit <> 'D'").select("conv_id", "at", "place", "edit", new.alias("role"), text.alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and sha256 of the repaired ``role:text`` lines of every conversation
    that has any.  A conversation goes through one hash in order, one row at a time."""
    line = F.concat("role", F.lit(":"), "text").alias("line")
    rows = turns.select("conv_id", "at", "place", line).repartition("conv_id").sortWithinPartitions("conv_id", "at", "place")
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, digest string"
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def table(done):
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), wanted)], schema=wanted)

    def run(batches):
        conv, seen = None, None
        for batch in batches:
            done = []
            for this, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seen is None or this != conv:
                    if seen is not None:
                        done.append((conv, seen.hexdigest()))
                    conv, seen = this, hashlib.sha256()
                else:
                    seen.update(b"\n")
                seen.update(text.encode())
            if done:
                yield table(done)
        if seen is not None:
            yield table([(conv, seen.hexdigest())])

    return rows.select("conv_id", "line").mapInArrow(run, schema)
