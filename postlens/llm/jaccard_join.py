"""Near-duplicate classes: an n-gram Jaccard join with set-relation skipping.

A document is the set of its word shingles. Equal sets are one set from the start. The
shingles that more than one set holds are numbered and counted exactly; each set is ordered
by that count, rarest first, so two similar sets share one of their first shingles (the
prefix), and a set whose prefix is its own has no partner. The prefixes make an inverted
index whose entries know their position and set size.

* Answers of a similar set are used first: the smallest set of a list, its leader, is
  compared with the members. Sets that are linked to it, or to each other through other
  leaders, are in one class, and no pair within a class is looked at again.
* Lists with one class are skipped. In the others only pairs of different classes are left,
  and what is known of the leader decides most of them: Jaccard distance is a metric, so
  sets whose distances from the leader differ by more than the bound cannot be linked.
* Lists are cut into blocks of similar set size and read by position: blocks and entries
  which leave too little of either set for the wanted overlap are skipped.

Every pair that remains is compared exactly. Links are never lost, copies never become pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Scratch, arrow_schema, kept_rows, only, shuffle_partitions, slices, text_key, text_or_empty
from postlens.llm.components import components
from postlens.llm.words import Words, mix, planes, unplanes

WIDTH = 5
#: Similarity as a fraction, so that no comparison is rounded.
LEAST = (75, 100)

_BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
_TOKEN = np.uint64((1 << 48) - 1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles of all texts in a row, number of each text, name of each text's set)."""
    words = Words(texts, lower=True)
    value, owner = words.shingles(width, _BASES[0])
    count, first = words.counts(), words.first
    short = {}
    for i in np.flatnonzero((count > 0) & (count < width)):
        # The whole sequence is one shingle, unlike any of full width.
        h = np.full(1, count[i], np.uint64)
        for w in words.hash[first[i] : first[i + 1]]:
            h = mix(h * np.uint64(_BASES[1]) + w)
        short[i] = h
    sets, none = [], np.zeros(0, np.uint64)
    for i in range(len(words)):
        if count[i] >= width:
            sets.append(np.unique(value[first[i] : first[i + 1] - width + 1]))
        else:
            sets.append(short.get(i, none))
    n = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else none
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens ^ np.uint64(_BASES[1])), out=total[1:])
    ends = np.cumsum(n)
    names = mix(total[ends] - total[ends - n] + n.astype(np.uint64)).view(np.int64)
    return tokens, n, names


def _set_rows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_key string, n_shingles bigint, set_key bigint"
    out = arrow_schema(schema)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in slices(batches):
            _, n, names = shingle_sets(run.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [run.column("doc_id"), run.column("text_key").cast(pa.string()), pa.array(n), pa.array(names)], schema=out
            )

    return docs.mapInArrow(name, schema)


def _shared_shingles(docs: DataFrame, width: int) -> DataFrame:
    """The shingles that several sets hold, numbered, with their numbers of sets: arrays of
    sets, their sizes, shingle ids and counts, one row per bucket of shingles and bucket of
    sets."""
    buckets = shuffle_partitions(docs.sparkSession)
    schema = "bucket int, sets binary, sizes binary, runs binary, shingles binary"
    out = arrow_schema(schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in slices(batches):
            tokens, n, names = shingle_sets(run.column("text"), width)
            _, at = np.unique(names, return_index=True)  # equal sets of these rows travel once
            owner = np.repeat(np.arange(len(n)), n)
            stay = np.zeros(len(n), bool)
            stay[at] = True
            tokens, owner = tokens[stay[owner]], owner[stay[owner]]
            bucket = ((tokens >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket * len(n) + owner, kind="stable")
            tokens, owner, bucket = tokens[order] & _TOKEN, owner[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cut)):
                part = slice(cut[k], cut[k + 1])
                who, runs = np.unique(owner[part], return_counts=True)
                low = np.ascontiguousarray(tokens[part]).view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((int(k), planes(names[who]), planes(n[who].astype(np.int32)), planes(runs.astype(np.int32)), low.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys, sizes, runs = _read(table, "sets", np.int64), _read(table, "sizes", np.int32), _read(table, "runs", np.int32)
        low = np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint8).reshape(-1, 6)
        tokens = np.zeros((len(low), 8), np.uint8)
        tokens[:, :6] = low
        tokens = tokens.view(np.uint64).ravel()
        order = np.argsort(tokens)
        value = tokens[order]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        lone = new & np.append(new[1:], True)
        order = order[~lone]
        run = np.repeat(np.arange(len(keys)), runs)[order]
        value, key, size = tokens[order], keys[run], sizes[run]
        order = np.lexsort((key, value))
        value, key, size = value[order], key[order], size[order]
        keep = np.ones(len(value), bool)  # a set that came from several runs of rows counts once
        keep[1:] = (value[1:] != value[:-1]) | (key[1:] != key[:-1])
        value, key, size = value[keep], key[keep], size[keep]
        _, number, held = np.unique(value, return_inverse=True, return_counts=True)
        more = held[number] > 1
        key, size, number = key[more], size[more], number[more]
        ids, held = number * buckets + bucket, held[number].astype(np.int32)
        back = key % buckets
        order = np.lexsort((key, back))
        key, size, ids, held, back = (x[order] for x in (key, size, ids, held, back))
        cut = np.searchsorted(back, np.arange(buckets + 1))
        rows = [
            (int(k), *(planes(x[cut[k] : cut[k + 1]]) for x in (key, size, ids, held))) for k in np.flatnonzero(np.diff(cut))
        ]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), back_out)] if rows else back_out.empty_table().columns, schema=back_out)

    back_schema = "back int, sets binary, sizes binary, ids binary, counts binary"
    back_out = arrow_schema(back_schema)
    dealt = docs.select("text").mapInArrow(deal, schema)
    return dealt.groupBy("bucket").applyInArrow(count, back_schema)


def _read(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([unplanes(x, kind) for x in table.column(column).to_pylist()])


def _prefix(n: int, least: tuple[int, int]) -> int:
    """Shingles of which a partner must hold one: all but the overlap it needs at least."""
    return n - -(-n * least[0] // least[1]) + 1


def _ordered_sets(shared: DataFrame, least: tuple[int, int]) -> DataFrame:
    """set_key, n, ids: sets that may have a partner, with their shared shingles, rarest first."""
    schema = "set_key bigint, n int, ids binary"
    out = arrow_schema(schema)

    def order(table: pa.Table) -> pa.Table:
        key, n = _read(table, "sets", np.int64), _read(table, "sizes", np.int32)
        ids, held = _read(table, "ids", np.int64), _read(table, "counts", np.int32)
        by = np.lexsort((ids, held, key))
        key, n, ids = key[by], n[by], ids[by]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(starts[1:], len(key))
        may = [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if n[a] - (b - a) < _prefix(int(n[a]), least)]
        first = np.array([a for a, _ in may], np.int64)
        return pa.table(
            [pa.array(key[first]), pa.array(n[first]), pa.array([ids[a:b].tobytes() for a, b in may], pa.binary())], schema=out
        )

    return shared.groupBy("back").applyInArrow(order, schema)


def _index(sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """id, set_key, n, pos, lone: the index entries; ``lone`` shingles are the set's own."""
    schema = "id bigint, set_key bigint, n int, pos int, lone int"
    out = arrow_schema(schema)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in batches:
            parts = []
            for key, n, ids in zip(*(run.column(c).to_pylist() for c in ("set_key", "n", "ids"))):
                ids = np.frombuffer(ids, np.int64)
                own = n - len(ids)
                ids = ids[: _prefix(n, least) - own]
                parts.append((ids, np.full(len(ids), key), np.full(len(ids), n, np.int32), np.arange(own, own + len(ids), dtype=np.int32), np.full(len(ids), own, np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=out)

    return sets.mapInArrow(entries, schema)


def _may_link(n1: Column, pos1: Column, n2: Column, pos2: Column, least: tuple[int, int]) -> Column:
    """Whether two entries leave enough of both sets for the overlap, if this shingle is the
    first that they share."""
    rest = F.least(n1 - pos1, n2 - pos2)
    return (rest * sum(least) >= (n1 + n2) * least[0]) & (F.least(n1, n2) * least[1] >= F.greatest(n1, n2) * least[0])


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both, total: sizes of intersection and union of each pair, counted exactly."""
    schema = "a bigint, b bigint, both int, total int"
    out = arrow_schema(schema)
    side = lambda x: sets.select(F.col("set_key").alias(x), F.col("n").alias(f"n{x}"), F.col("ids").alias(f"ids{x}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in batches:
            columns = [run.column(c).to_pylist() for c in ("idsa", "idsb")]
            both = np.array([
                len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
                for x, y in zip(*columns)
            ], np.int32)
            total = (run.column("na").to_numpy() + run.column("nb").to_numpy() - both).astype(np.int32)
            yield pa.RecordBatch.from_arrays([run.column("a"), run.column("b"), pa.array(both), pa.array(total)], schema=out)

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "idsa", "idsb").mapInArrow(compare, schema)


def _is_link(least: tuple[int, int]) -> Column:
    return F.col("both") * F.lit(least[1]) >= F.col("total") * F.lit(least[0])


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """Whole groups of rows that agree in ``columns``, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for run in batches:
        if not run.num_rows:
            continue
        change = np.zeros(run.num_rows, bool)
        for c in columns:
            x = run.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
            change[0] |= bool(held) and held[-1].column(c)[-1].as_py() != x[0]
        at = np.flatnonzero(change).tolist()
        for a, b in zip([0, *at], [*at, run.num_rows]):
            if a in at and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(run.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _cross_pairs(entries: DataFrame, least: tuple[int, int]) -> DataFrame:
    """a, b: pairs of different classes in a list that neither size, position nor the
    leader's answers rule out."""
    schema = "a bigint, b bigint"
    out = arrow_schema(schema)
    top, bottom = least

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("id", "block")):
            n, pos, key, root, own, known = (
                group.column(c).to_numpy(zero_copy_only=False) for c in ("n", "pos", "set_key", "root", "own", "distance")
            )
            order = np.lexsort((pos, n))
            n, pos, key, root, own, known = (x[order] for x in (n, pos, key, root, own, known))
            roots, at, size = np.unique(root, return_inverse=True, return_counts=True)
            if len(roots) < 2:
                continue
            most = size.argmax()
            left, right = [], []
            outside = np.flatnonzero(at != most)
            for i in outside:
                # Entries are in order of set size: those of fitting size are one slice.
                low = np.searchsorted(n, -(-n[i] * top // bottom))
                high = np.searchsorted(n, n[i] * bottom // top, side="right")
                j = np.arange(low, high)
                j = j[(root[j] != root[i]) & ((at[j] == most) | (j > i)) & (own[j] | own[i])]
                j = j[np.minimum(n[j] - pos[j], n[i] - pos[i]) * (top + bottom) >= (n[j] + n[i]) * top]
                gap = np.abs(known[j] - known[i])  # NaN where the leader's answer is not known
                j = j[~(gap > 1 - top / bottom + 1e-9)]
                left.append(np.full(len(j), key[i]))
                right.append(key[j])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=out)

    placed = entries.repartition(shuffle_partitions(entries.sparkSession), "id", "block").sortWithinPartitions("id", "block")
    return placed.mapInArrow(pairs, schema).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, text_key.

    A-Z are lower-cased; a set holds the distinct shingles of ``width`` words, or the whole
    sequence where there are fewer. Sets are linked if their Jaccard similarity is at least
    ``least``; component_id is the smallest doc_id reachable by links, itself included. Null
    text and text without words have no shingles and no links. Null doc_ids are passed over
    as component_id unless the whole class has none. Repeated rows are in one class. An empty
    table gives no rows. Other columns are not read. Shingles are compared by 64-bit hashes,
    within a pair of sets.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-join")
    read = only(docs, "doc_id", "text").select("doc_id", text_key().alias("text_key"), text_or_empty().alias("text"))
    rows = scratch.table(_set_rows(read, width), "rows")
    sets = scratch.table(_ordered_sets(_shared_shingles(read, width), least), "sets")

    index = _index(sets, least)
    # The leader has the fewest shingles of its own, so it is near the middle of its kind.
    heads = scratch.table(
        index.groupBy("id").agg(F.min(F.struct("lone", "set_key")).alias("first"), F.count(F.lit(1)).alias("held"))
        .filter("held > 1").select("id", F.col("first.set_key").alias("leader")),
        "heads",
    )
    entries = scratch.table(index.join(heads, "id"), "entries")
    lead = entries.filter("set_key = leader").select("id", F.col("n").alias("n1"), F.col("pos").alias("pos1"))
    stars = (
        entries.filter("set_key != leader").join(lead, "id")
        .filter(_may_link(F.col("n"), F.col("pos"), F.col("n1"), F.col("pos1"), least))
        .select(F.col("leader").alias("a"), F.col("set_key").alias("b")).distinct()
    )
    answers = scratch.table(_overlaps(stars, sets), "answers")
    links = answers.filter(_is_link(least)).select("a", "b")
    roots = scratch.table(components(links, scratch, "first"), "first-roots")

    root = F.coalesce("root", "set_key")
    classed = scratch.table(
        entries.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", root), "classed"
    )
    several = scratch.table(
        classed.groupBy("id").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 < r2").select("id"),
        "several",
    )
    distance = answers.select(
        F.col("a").alias("leader"), F.col("b").alias("set_key"), (1 - F.col("both") / F.col("total")).alias("distance")
    )
    known = F.when(F.col("set_key") == F.col("leader"), F.lit(0.0)).otherwise(F.coalesce("distance", F.lit(float("nan"))))
    # Sizes that can match differ by one block at most: an entry stands in its own block and
    # in the one below, and a pair counts where one of the two is in its own.
    ratio = F.lit(least[1] / least[0])
    block = F.floor(F.log(F.col("n") + 0.5) / F.log(ratio)).cast("int")
    open_lists = classed.join(several, "id").join(distance, ["leader", "set_key"], "left").withColumn("distance", known)
    blocks = open_lists.withColumn("own_block", block).withColumn(
        "block", F.explode(F.array("own_block", F.col("own_block") - 1))
    ).withColumn("own", F.col("block") == F.col("own_block"))
    crossing = scratch.table(_cross_pairs(blocks, least), "crossing")
    unknown = crossing.join(answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = scratch.table(_overlaps(unknown, sets).filter(_is_link(least)).select("a", "b"), "more-links")
    merged = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), scratch, "second")
    merged = scratch.table(merged, "second-roots")

    alone = F.when(F.col("n_shingles") == 0, F.lit(None)).otherwise(root)
    labelled = scratch.table(
        rows.join(merged.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", alone), "labelled"
    )
    smallest = scratch.table(
        labelled.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest"
    )
    return labelled.join(smallest, "root", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "text_key",
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id; columns unchanged."""
    first = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return kept_rows(docs, first.select("doc_id", "text_key"))
