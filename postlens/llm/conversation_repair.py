"""Damage and repair of conversations: cost DP, then the least audit by prefix doubling.

A legal conversation is empty, or an optional system turn followed by pairs of user and
assistant. Rows are kept, given another role or deleted, and empty turns inserted; the
repair with the least cost is taken, and of equally cheap ones that with the ASCII-least
audit (one letter for each edit).

Rows are numbered in order of their conversation by a range split, so a conversation of any
length lies in many tasks; every 1024 numbers are a segment. The cost of a segment is a
matrix between the four states of the automaton, and a backward pass over these small
matrices gives the costs that are left after each segment. Within a segment all nodes (row,
state) then know their cheapest arcs. The letter of an arc fixes where it leads, so a node
has one least arc. Nodes are ranked by the next letter, then by the next 2, 4, 8, … letters,
each time from the ranks of a node and of the node that its doubled pointer reaches; an arc
is chosen by its letter and the rank of its target, and the audit is read along the doubled
pointers, in as many steps as its length has bits. A forward pass joins the segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Scratch, arrow_schema, only, shuffle_partitions

#: Row numbers of a segment, as a power of two.
SEGMENT_BITS = 10
BLANKS = " \t\n\v\f\r"
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Faults of a row; a letter of a segment's ``codes`` is chr(65 + 4 * fault + role).
PLAIN, CUT, BLANK, COPY = range(4)
#: Role initials, in the order of their numbers; 3 is any other.
INITIALS = "sua"
#: States: nothing said yet, system, user or assistant said last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or relabelled turn leads.
NEXT = np.array([USER, USER, ASSISTANT, USER])
NEVER = 1 << 50
_PAD = 16
LETTERS = " DIKR"
_CELLS = 1 << 14


def _keep(state: int, role: int) -> int:
    """The state after a turn of ``role`` as it is, or -1."""
    if role == 0:
        return SYSTEM if state == EMPTY else -1
    return int(NEXT[state]) if role < 3 and NEXT[state] == role + 1 else -1


#: By code (16: no row) and state: cost and target of keeping; by code: the other costs.
KEEP_TO = np.array([[max(0, _keep(s, c % 4)) for s in range(4)] for c in range(17)])
KEEP_COST = np.array([
    [(TRUNCATED if c // 4 == CUT else 0) if c < 8 and _keep(s, c % 4) >= 0 else NEVER for s in range(4)] for c in range(17)
])
REROLE_COST = np.array([REROLE + (TRUNCATED if c // 4 == CUT else 0) if c < 8 else NEVER for c in range(17)])
DELETE_COST = np.array([DELETE] * 16 + [0])
INSERT_COST = np.array([INSERT] * 16 + [NEVER])


def _column(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs before rows of ``code`` (segments), from those after them (segments, …, 4)."""
    wide = (len(code),) + (1,) * (after.ndim - 2)
    shape = lambda x: x.reshape(wide + x.shape[1:]) if x.ndim > 1 else x.reshape(wide + (1,))
    target = np.broadcast_to(shape(KEEP_TO[code]), after.shape)
    best = np.minimum(after + shape(DELETE_COST[code]), np.take_along_axis(after, target, -1) + shape(KEEP_COST[code]))
    best = np.minimum(best, after[..., NEXT] + shape(REROLE_COST[code]))
    more = shape(INSERT_COST[code])
    # Two insertions lead back to user or assistant, so a third is never cheaper.
    return np.minimum(best, np.minimum(best[..., NEXT] + more, best[..., NEXT[NEXT]] + 2 * more))


def matrices(codes: np.ndarray) -> np.ndarray:
    """Costs [segment, exit state, entry state] of padded segments of row codes."""
    cost = np.full((len(codes), 4, 4), NEVER)
    cost[:, range(4), range(4)] = 0
    for i in range(codes.shape[1] - 1, -1, -1):
        cost = np.minimum(_column(codes[:, i], cost), NEVER)
    return cost


def least_paths(codes: np.ndarray, sizes: np.ndarray, left: np.ndarray, last: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """For padded segments of row codes: audits [segment][entry state] and the exit states
    [segment, entry state], given the costs ``left`` [segment, state] after each segment. In
    the ``last`` segment of a conversation the audit has the insertions after all rows."""
    n, width = codes.shape
    cost = np.empty((n, width + 1, 4), np.int64)
    cost[:, width] = left
    for i in range(width - 1, -1, -1):
        cost[:, i] = np.minimum(_column(codes[:, i], cost[:, i + 1]), NEVER)

    # The arcs of node (segment, row, state), by letter: cost and target.
    node = np.arange(n * (width + 1) * 4).reshape(n, width + 1, 4)
    full = np.concatenate([codes, np.full((n, 1), _PAD)], 1)
    inside = np.arange(width + 1) < sizes[:, None]
    after = np.concatenate([cost[:, 1:], np.full((n, 1, 4), NEVER)], 1)
    below = np.concatenate([node[:, 1:], node[:, -1:]], 1)
    ends = last[:, None] & (np.arange(width + 1) == sizes[:, None])
    never = np.full(cost.shape, NEVER)
    insert = np.where(ends, INSERT, INSERT_COST[full])[..., None] + cost[..., NEXT]
    through = [
        (DELETE_COST[full][..., None] + after, below),
        (insert, node[..., NEXT]),
        (KEEP_COST[full] + np.take_along_axis(after, KEEP_TO[full], -1), np.take_along_axis(below, KEEP_TO[full], -1)),
        (REROLE_COST[full][..., None] + after[..., NEXT], below[..., NEXT]),
    ]
    arcs = [(np.where(inside[..., None] | (ends[..., None] & (k == 1)), c, never), to) for k, (c, to) in enumerate(through)]
    best = np.stack([(c == cost) & (cost < NEVER) for c, _ in arcs]).reshape(4, -1)
    targets = np.stack([to for _, to in arcs]).reshape(4, -1)

    # Ranks by 1, 2, 4, … letters; a node without an arc is the end and reaches itself.
    some = best.any(0)
    pointer = np.where(some, targets[best.argmax(0), np.arange(best.shape[1])], node.ravel())
    rank = np.where(some, best.argmax(0) + 1, 0)
    pointers, longest = [], 2 * width + 4
    while 1 << len(pointers) < longest:
        pointers.append(pointer)
        _, rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)
        pointer = pointer[pointer]
    # The letter decides between the arcs of a node, then the rank of the target.
    weight = np.where(best, np.arange(1, 5)[:, None] * (rank.max() + 1) + rank[targets], np.iinfo(np.int64).max)
    letter = np.where(some, weight.argmin(0) + 1, 0)

    walk = node[:, 0].reshape(-1, 1)
    for jump in pointers:
        walk = np.concatenate([walk, jump[walk]], 1)
    signs = np.frombuffer(LETTERS.encode(), np.uint8)[letter[walk]]
    audits = [line.tobytes().decode().rstrip() for line in signs]
    exits = pointer[node[:, 0]] % 4
    return [audits[4 * k : 4 * k + 4] for k in range(n)], exits


def _padded(batch: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(places, codes, sizes) of segments of like length, a bounded number of cells at once."""
    by_size: dict[int, list[int]] = {}
    for k, codes in enumerate(batch):
        by_size.setdefault(max(1, len(codes) - 1).bit_length(), []).append(k)
    for places in by_size.values():
        width = max(len(batch[k]) for k in places)
        step = max(1, _CELLS // width)
        for start in range(0, len(places), step):
            part = places[start : start + step]
            sizes = np.array([len(batch[k]) for k in part])
            cells = np.full((len(part), width), _PAD)
            for row, k in enumerate(part):
                cells[row, : sizes[row]] = np.frombuffer(batch[k].encode(), np.uint8) - 65
            yield part, cells, sizes


def illegal_pairs(roles: np.ndarray) -> int:
    """Neighbouring role numbers other than system-user, user-assistant, assistant-user."""
    one, two = roles[:-1], roles[1:]
    legal = ((one == 0) & (two == 1)) | ((one == 1) & (two == 2)) | ((one == 2) & (two == 1))
    return int((~legal).sum())


def _or_blank(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: the rows after the damage that their key decides."""
    fault = F.crc32(F.concat(_or_blank("conv_id"), F.lit(":"), _or_blank("turn"))) % 20
    text = _or_blank("text")
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        only(conversations, "conv_id", "turn", "role", "text").withColumn("fault", fault).filter("fault != 0")
        .select(
            "conv_id", "turn",
            F.when(F.col("fault") == 4, F.lit("user")).otherwise(_or_blank("role")).alias("role"),
            F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate(text, ".!?", ""))
            .otherwise(text).alias("text"),
            F.explode(copies).alias("copy"),
        )
    )


#: The order of a conversation's rows; rows that agree in all of it are equal.
ORDER = [F.asc_nulls_first, F.asc_nulls_first, F.asc, F.asc]


def _in_order(*more: Column) -> list[Column]:
    return [fn(c) for fn, c in zip(ORDER, ("conv_id", "turn", "role", "content"))] + list(more)


def _segments(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, segment, codes), and (conv_id, gaps)."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    final = F.right(trimmed, F.lit(1))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    slim = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("content"), role.alias("number"),
        F.when(trimmed == "", BLANK).when(final.isin(".", "!", "?"), PLAIN).otherwise(CUT).alias("state"),
        # Splits rows that are equal in everything else, too.
        F.monotonically_increasing_id().alias("tie"),
    )
    order = _in_order(F.asc("tie"))
    ordered = scratch.table(
        slim.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
        .drop("tie").withColumn("place", F.monotonically_increasing_id()),
        "ordered",
    )
    first = ordered.groupBy("conv_id", "role", "content").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("state") == BLANK, BLANK).when(F.col("first").isNull(), COPY).otherwise(F.col("state"))
    marked = ordered.join(first, "place", "left").select(
        "conv_id", "place", F.shiftright("place", SEGMENT_BITS).alias("segment"),
        F.char(F.lit(65) + 4 * fault + F.col("number")).alias("code"),
    )
    letters = F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"])
    segments = marked.groupBy("conv_id", "segment").agg(F.array_join(letters, "").alias("codes"))
    gaps = ordered.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("rows")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")
    )
    return scratch.table(segments, "segments"), gaps


def _batches(rows: Iterator[tuple], out: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)


def _audits(segments: DataFrame, scratch: Scratch, id_type: str) -> DataFrame:
    """conv_id, segment, audit, cost, blank, duplicate, truncated, illegal: what each segment
    adds to its conversation's."""
    buckets = shuffle_partitions(segments.sparkSession)

    weighed_schema = f"conv_id {id_type}, segment bigint, codes string, matrix binary"
    weighed_out = arrow_schema(weighed_schema)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in batches:
            codes = run.column("codes").to_pylist()
            found: list[bytes] = [b""] * len(codes)
            for places, cells, _ in _padded(codes):
                for k, matrix in zip(places, matrices(cells)):
                    found[k] = matrix.tobytes()
            columns = [run.column("conv_id"), run.column("segment"), run.column("codes"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, weighed_out)], schema=weighed_out)

    left_schema = f"conv_id {id_type}, segment bigint, codes string, left binary, last boolean"
    left_out = arrow_schema(left_schema)

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, begun, left = None, False, None
            for run in batches:
                for conv, segment, codes, matrix in zip(*(run.column(c).to_pylist() for c in weighed_out.names)):
                    last = not begun or conv != now
                    if last:
                        # What ends here must have answered its user: one or two turns are inserted.
                        now, begun, left = conv, True, np.array([0, 2 * INSERT, INSERT, 0])
                    yield conv, segment, codes, left.astype(np.int64).tobytes(), last
                    left = np.minimum((np.frombuffer(matrix, np.int64).reshape(4, 4) + left[:, None]).min(0), NEVER)

        yield from _batches(rows(), left_out)

    path_schema = f"conv_id {id_type}, segment bigint, codes string, audits array<string>, exits array<int>"
    path_out = arrow_schema(path_schema)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in batches:
            codes = run.column("codes").to_pylist()
            left = np.frombuffer(b"".join(run.column("left").to_pylist()), np.int64).reshape(-1, 4)
            last = run.column("last").to_numpy(zero_copy_only=False)
            audits, exits = [None] * len(codes), [None] * len(codes)
            for places, cells, sizes in _padded(codes):
                found, reached = least_paths(cells, sizes, left[places], last[places])
                for k, a, e in zip(places, found, reached.tolist()):
                    audits[k], exits[k] = a, e
            columns = [run.column("conv_id"), run.column("segment"), run.column("codes")]
            columns += [pa.array(audits, path_out.field("audits").type), pa.array(exits, path_out.field("exits").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, path_out)], schema=path_out)

    schema = (
        f"conv_id {id_type}, segment bigint, audit string, cost bigint, blank bigint, duplicate bigint, "
        "truncated bigint, illegal bigint"
    )
    out = arrow_schema(schema)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, begun, state, before = None, False, EMPTY, np.zeros(0, int)
            for run in batches:
                for conv, segment, codes, audits, exits in zip(*(run.column(c).to_pylist() for c in path_out.names)):
                    if not begun or conv != now:
                        now, begun, state, before = conv, True, EMPTY, np.zeros(0, int)
                    code = np.frombuffer(codes.encode(), np.uint8) - 65
                    fault, audit = code // 4, audits[state]
                    left = np.frombuffer(audit.replace("I", "").encode(), np.uint8) != ord("D")
                    cost = (
                        DELETE * audit.count("D") + INSERT * audit.count("I") + REROLE * audit.count("R")
                        + TRUNCATED * int((left & (fault == CUT)).sum())
                    )
                    roles = np.concatenate([before, code % 4])
                    counts = [int((fault == f).sum()) for f in (BLANK, COPY, CUT)]
                    yield conv, segment, audit, cost, *counts, illegal_pairs(roles)
                    state, before = exits[state], roles[-1:]

        yield from _batches(rows(), out)

    weighed = segments.mapInArrow(weigh, weighed_schema)
    behind = [F.asc_nulls_first("conv_id"), F.desc("segment")]
    left = scratch.table(weighed.repartition(buckets, "conv_id").sortWithinPartitions(*behind).mapInArrow(backward, left_schema), "left")
    found = left.mapInArrow(paths, path_schema).repartition(buckets, "conv_id")
    return scratch.table(
        found.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc("segment")).mapInArrow(forward, schema), "audits"
    )


def _turns(audits: DataFrame, rows: DataFrame, id_type: str) -> DataFrame:
    """conv_id, place, role, text: the repaired turns, in order of ``place``; conversations
    without any have none. A conversation's audit comes before its rows in the same stream,
    so its rows are held one at a time."""
    buckets = shuffle_partitions(rows.sparkSession)
    pieces = audits.select(
        "conv_id", F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit("").alias("role"), F.lit("").alias("content"),
        F.lit(None).cast("string").alias("text"), "segment", "audit",
    )
    texts = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("content"), "text",
        F.lit(None).cast("bigint").alias("segment"), F.lit(None).cast("string").alias("audit"),
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_last("segment"), *_in_order()[1:]]
    schema = f"conv_id {id_type}, place bigint, role string, text string"
    out = arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            now, begun, audit, at, place, state = None, False, [], 0, 0, EMPTY

            def inserted() -> Iterator[tuple]:
                nonlocal at, place, state
                while at < len(audit) and audit[at] == "I":
                    state = int(NEXT[state])
                    yield now, place, "user" if state == USER else "assistant", ""
                    at, place = at + 1, place + 1

            for run in batches:
                for conv, segment, piece, role, text in zip(*(run.column(c).to_pylist() for c in ("conv_id", "segment", "audit", "role", "text"))):
                    if not begun or conv != now:
                        if begun:
                            audit = "".join(audit)
                            yield from inserted()
                        now, begun, audit, at, place, state = conv, True, [], 0, 0, EMPTY
                    if segment is not None:
                        audit.append(piece)
                        continue
                    if isinstance(audit, list):
                        audit = "".join(audit)
                    yield from inserted()
                    edit = audit[at]
                    at += 1
                    if edit == "D":
                        continue
                    if edit == "R":
                        state = int(NEXT[state])
                        role = "user" if state == USER else "assistant"
                    else:
                        state = _keep(state, INITIALS.index(role[0]))
                    yield now, place, role, text
                    place += 1
            if begun:
                audit = "".join(audit)
                yield from inserted()

        yield from _sized(turns(), out)

    return pieces.unionByName(texts).repartition(buckets, "conv_id").sortWithinPartitions(*order).select(
        "conv_id", "segment", "audit", "role", "text"
    ).mapInArrow(apply, schema)


def _sized(rows: Iterator[tuple], out: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` bytes of text (the last column)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1])
        if size > most:
            yield from _batches(iter(held), out, len(held))
            held, size = [], 0
    if held:
        yield from _batches(iter(held), out, len(held))


def _digests(turns: DataFrame, id_type: str) -> DataFrame:
    """conv_id, repaired_sha256: over the turns of each conversation, fed one after another."""
    schema = f"conv_id {id_type}, repaired_sha256 string"
    out = arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, begun, state = None, False, None
            for run in batches:
                for conv, role, text in zip(*(run.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                    if not begun or conv != now:
                        if begun:
                            yield now, state.hexdigest()
                        now, begun, state = conv, True, hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(f"{role}:{text}".encode())
            if begun:
                yield now, state.hexdigest()

        yield from _batches(rows(), out)

    # The turns come from one task a conversation, in their order: no shuffle in between.
    return turns.select("conv_id", "role", "text").mapInArrow(digest, schema)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the turns of all repaired conversations (see ``repair``)."""
    scratch = Scratch(conversations.sparkSession, "conversation-turns")
    rows, id_type = damaged(conversations), dict(conversations.dtypes)["conv_id"]
    segments, _ = _segments(rows, scratch)
    return _turns(_audits(segments, scratch, id_type), rows, id_type)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Rows are damaged by the CRC-32 of ``conv_id:turn`` modulo 20 (null: one space, as in role
    and text) and taken by turn, null first, then by role and the SHA-256 of the text; rows
    that agree in these are equal, so their order does not matter. A null conv_id is a
    conversation of its own; empty role and text are themselves. ``turn`` must be an integer;
    conv_id may have any type. A conversation all of whose rows were dropped has zeros, an
    empty audit and the hash of no text. Repeated rows are duplicates. An empty table gives no
    rows. Other columns are not read.

    ``audit`` and ``repaired_sha256`` are single values of a whole conversation. The hash reads
    the turns of a conversation in one task, one at a time; the rest is spread by segments.
    """
    scratch = Scratch(conversations.sparkSession, "conversation-repair")
    rows, id_type = damaged(conversations), dict(conversations.dtypes)["conv_id"]
    segments, gaps = _segments(rows, scratch)
    audits = _audits(segments, scratch, id_type)
    texts = _digests(_turns(audits, rows, id_type), id_type)

    pieces = F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"])
    counts = ("cost", "blank", "duplicate", "truncated", "illegal")
    whole = audits.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in counts], F.array_join(pieces, "").alias("audit"))
    # Nothing is compared to null: a null id has a flag and the id a stand-in.
    parts = [whole, gaps, texts]
    out = only(conversations, "conv_id").distinct()
    for k, part in enumerate(parts):
        part = part.withColumnRenamed("conv_id", f"id{k}")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(f"id{k}")), "left").drop(f"id{k}")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
