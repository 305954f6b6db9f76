"""Chat formatting: the cheapest repair of a conversation's roles, rendered.

A legal conversation may open with a system turn, then user and assistant alternate. Each
given turn is kept, merged into the turn before, relabelled, or preceded by an empty turn;
the cheapest sequence of such steps through the automaton of legal turns is found by
dynamic programming.

The costs of a run of turns are a matrix, from state to state, and matrices of neighbouring
runs multiply (minimum of sums). So a long conversation is cut into segments that are solved
apart; a chain over the segments' matrices fixes the states at their borders, and each
segment is then repaired and rendered between its two states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Scratch, arrow_schema, only, shuffle_partitions

ROLES = ("system", "user", "assistant")
#: States are the role of the last turn; START before any.
START = len(ROLES)
#: The roles that may follow each state.
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
KEEP, MERGE, INSERT, RELABEL, RELABEL_MERGE = "keep", "merge", "insert", "relabel", "relabel+merge"
COST = {KEEP: 0, MERGE: 1, INSERT: 2, RELABEL: 3, RELABEL_MERGE: 4}
#: Turn numbers per segment.
SEGMENT = 1024
NEVER = 1 << 40

#: (cost, state after, action, role of an empty turn before or -1, new turns)
Step = tuple[int, int, str, int, int]


def steps(state: int, role: int) -> list[Step]:
    """Everything that may be done with a turn of ``role`` (-1: unknown) in ``state``."""
    found = []
    for r in NEXT[state]:
        if r == role:
            found.append((COST[KEEP], r, KEEP, -1, 1))
        else:
            found.append((COST[RELABEL], r, RELABEL, -1, 1))
            if role in NEXT[r]:
                found.append((COST[INSERT], role, INSERT, r, 2))
    if state != START:
        found.append((COST[MERGE], state, MERGE, -1, 0) if state == role else (COST[RELABEL_MERGE], state, RELABEL_MERGE, -1, 0))
    return found


_STEPS = {(s, r): steps(s, r) for s in range(4) for r in range(-1, len(ROLES))}


def solve(roles: list[int], entry: int) -> list[list[tuple[int, int, Step | None, int]]]:
    """For each number of turns done and each state: (cost, state before, step, new turns)
    of the cheapest way from ``entry``. Of equal costs the smaller state before is taken,
    then the step listed first."""
    table = [[(NEVER, -1, None, 0)] * 4]
    table[0][entry] = (0, -1, None, 0)
    for role in roles:
        best = [(NEVER, -1, None, 0)] * 4
        for s in range(4):
            cost, _, _, turns = table[-1][s]
            if cost >= NEVER:
                continue
            for step in _STEPS[s, role]:
                if cost + step[0] < best[step[1]][0]:
                    best[step[1]] = (cost + step[0], s, step, turns + step[4])
        table.append(best)
    return table


def path(table: list, exit_state: int) -> list[tuple[int, Step]]:
    """(state before, step) of each turn, on the cheapest way to ``exit_state``."""
    out, state = [], exit_state
    for row in reversed(table[1:]):
        _, before, step, _ = row[state]
        out.append((before, step))
        state = before
    return out[::-1]


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else -1


def _chain(matrices: list[list[int]], turns: list[list[int]]) -> tuple[list[int], list[int], int]:
    """States at the segments' borders (one more than segments), new turns before each
    segment, and the whole cost."""
    cost = [[NEVER] * 4]
    cost[0][START] = 0
    for m in matrices:
        cost.append([min(cost[-1][s] + m[4 * s + e] for s in range(4)) for e in range(4)])
    total = min(cost[-1])
    states = [cost[-1].index(total)]
    for k in range(len(matrices) - 1, -1, -1):
        m, e = matrices[k], states[-1]
        states.append(min(range(4), key=lambda s: (cost[k][s] + m[4 * s + e], s)))
    states.reverse()
    before, n = [], 0
    for k, t in enumerate(turns):
        before.append(n)
        n += t[4 * states[k] + states[k + 1]]
    return states, before, total


def _sorted_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows that agree in ``columns``, from batches sorted by them."""
    held, name = [], None
    for run in batches:
        for row in run.to_pylist():
            key = tuple(row[c] for c in columns)
            if held and key != name:
                yield held
                held = []
            name = key
            held.append(row)
    if held:
        yield held


def format_chats(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per given turn and per inserted empty turn: conv_id, piece, turn, role,
    role_out, action, out_turn, conv_cost, rendered.

    The pieces of a conversation in order of ``piece`` are its rendering; a turn that was
    merged has the out_turn of the turn it went into. Turns are ordered by turn (null last),
    then role and text. Null text is empty; null and unknown roles are relabelled. A null
    conv_id is a conversation of its own. Repeated rows are turns like any other. An empty
    table gives no rows. Other columns are not read. Rows of equal turn number stay in one
    segment.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "chat-format")
    buckets = shuffle_partitions(spark)
    id_type = dict(conversations.dtypes)["conv_id"]
    read = only(conversations, "conv_id", "turn", "role", "text").withColumn(
        "segment", F.coalesce(F.floor(F.col("turn") / segment).cast("bigint"), F.lit((1 << 31) - 1))
    )
    order = [F.asc("conv_id"), F.asc("segment"), F.asc_nulls_last("turn"), F.asc("role")]

    costs_schema = f"conv_id {id_type}, segment bigint, costs array<bigint>, turns array<bigint>"
    costs_out = arrow_schema(costs_schema)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for group in _sorted_groups(batches, ("conv_id", "segment")):
            roles = [role_number(r["role"]) for r in group]
            ends = [solve(roles, s)[-1] for s in range(4)]
            rows.append((group[0]["conv_id"], group[0]["segment"], [x[0] for e in ends for x in e], [x[3] for e in ends for x in e]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), costs_out)], schema=costs_out)

    parts = scratch.table(
        read.select("conv_id", "segment", "turn", "role").repartition(buckets, "conv_id", "segment")
        .sortWithinPartitions(*order).mapInArrow(costs, costs_schema),
        "costs",
    )

    border_schema = f"conv_id {id_type}, segment bigint, entry int, exit int, before bigint, last boolean, conv_cost bigint"
    border_out = arrow_schema(border_schema)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for group in _sorted_groups(batches, ("conv_id",)):
            states, before, total = _chain([g["costs"] for g in group], [g["turns"] for g in group])
            for k, g in enumerate(group):
                rows.append((g["conv_id"], g["segment"], states[k], states[k + 1], before[k], k == len(group) - 1, total))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), border_out)], schema=border_out)

    # One row per segment, not per turn.
    chained = scratch.table(
        parts.repartition(buckets, "conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(borders, border_schema),
        "borders",
    )

    schema = (
        f"conv_id {id_type}, piece bigint, turn {dict(conversations.dtypes)['turn']}, role string, role_out string, action string, "
        "out_turn bigint, conv_cost bigint, rendered string"
    )
    out = arrow_schema(schema)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for group in _sorted_groups(batches, ("conv_id", "segment")):
            head = group[0]
            table = solve([role_number(r["role"]) for r in group], head["entry"])
            n, piece = head["before"], head["segment"] << 32
            for r, (_, step) in zip(group, path(table, head["exit"])):
                text = r["text"] or ""
                _, state, action, empty, new = step
                if empty >= 0:
                    rows.append((r["conv_id"], piece, None, None, ROLES[empty], "empty", n, head["conv_cost"], _open(n, empty)))
                    piece, n = piece + 1, n + 1
                if new:
                    shown, n = _open(n, state) + text, n + 1
                else:
                    shown = "\n" + text
                rows.append((r["conv_id"], piece, r["turn"], r["role"], ROLES[state], action, n - 1, head["conv_cost"], shown))
                piece += 1
                size += len(text)
            if head["last"]:
                rows[-1] = (*rows[-1][:-1], rows[-1][-1] + "<|end|>\n")
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    # A null id has a flag, so that it is no other id's equal whatever the ids' type.
    name = {"none": F.col("conv_id").isNull(), "name": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))}
    border = chained.select(*[c.alias(k) for k, c in name.items()], "segment", "entry", "exit", "before", "last", "conv_cost")
    whole = read.withColumns(name).join(border, [*name, "segment"])
    return (
        whole.repartition(buckets, "conv_id", "segment").sortWithinPartitions(*order, F.asc("text"))
        .mapInArrow(render, schema)
    )


def _open(turn: int, role: int) -> str:
    return ("<|end|>\n" if turn else "") + f"<|{ROLES[role]}|>\n"
