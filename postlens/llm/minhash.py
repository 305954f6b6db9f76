"""Near-duplicate classes by MinHash: banded minima, verified signatures, exact confirmation.

Every document is the set of its word shingles; equal sets are one set from the start. A
signature holds the minima of ``HASHES`` universal hash functions over the set. Sets whose
minima agree in a whole band meet in a bucket. There

* every member is held against the bucket's leader, the member that meets most others in
  all its buckets: pairs whose signatures agree too little are dropped, the others are
  confirmed on their full sets, and the links give classes;
* only members of different classes are then held against each other, in tiles of a bucket,
  so that no task gets a whole bucket. What each shares with the bucket's leader, and how
  many of its shingles no other open set holds, bounds what two members can share; pairs that
  this bound allows are compared by signature, then by full set.

Two sets in one class need no link of their own, so a large group of near copies costs its
stars and not its pairs. Classes are connected components by alternating large-star and
small-star steps over tables.

A link at the bound is lost if no band agrees, (1 - 0.85^5)^32 = 7e-9, or if the signature
shows less than ``ESTIMATE``, under 1e-5 by the Chernoff bound; more similar sets are safer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Scratch, arrow_schema, only, shuffle_partitions, slices, text_key, text_or_empty
from postlens.llm.components import components
from postlens.llm.jaccard_join import shingle_sets
from postlens.llm.words import mix

WIDTH = 3
#: Similarity as a fraction, so that no comparison is rounded.
LEAST = (85, 100)
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Share of agreeing minima below which a pair is not looked at.
ESTIMATE = 0.7
#: Sets of a bucket that meet in one tile, about.
TILE = 1024


def _functions(count: int, seed: int = 20240611) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and addends of multiply-and-shift hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, count, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, count, dtype=np.uint64)


def signatures(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Row by row the minima of all hash functions over each set of ``tokens``, none of them
    empty. Hashes are the high halves of a * x + b modulo 2**64."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), HASHES), np.uint32)
    for k, (a, b) in enumerate(zip(*_functions(HASHES))):
        out[:, k] = np.minimum.reduceat(((tokens * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_names(minima: np.ndarray) -> np.ndarray:
    """A 64-bit name of each band's place and minima, one column a band."""
    name = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(minima), BANDS))
    for r in range(ROWS):
        name = mix(name ^ minima[:, r::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(name).view(np.int64)


def _signed_rows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n, set_key, signature."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_key string, n bigint, set_key bigint, signature binary"
    out = arrow_schema(schema)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in slices(batches):
            tokens, n, names = shingle_sets(run.column("text"), width)
            signed: list[bytes | None] = [None] * len(n)
            some = np.flatnonzero(n)
            if len(some):
                for i, minima in zip(some.tolist(), signatures(tokens, n[some])):
                    signed[i] = minima.tobytes()
            columns = [run.column("doc_id"), run.column("text_key"), pa.array(n), pa.array(names), pa.array(signed, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return docs.mapInArrow(sign, schema)


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """set_key, ids: the sorted shingles of every document that has some; equal sets of a run
    of rows once."""
    schema = "set_key bigint, ids binary"
    out = arrow_schema(schema)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in slices(batches):
            tokens, n, names = shingle_sets(run.column("text"), width)
            ends = np.cumsum(n)
            first = [i for i in np.unique(names, return_index=True)[1].tolist() if n[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[first]), pa.array([tokens[ends[i] - n[i] : ends[i]].tobytes() for i in first], pa.binary())], schema=out
            )

    return docs.select("text").mapInArrow(sets, schema)


def _entries(sets: DataFrame) -> DataFrame:
    """at, band, set_key, n: each set in each of its bands, ``at`` being the band's number."""
    schema = "set_key bigint, n bigint, bands array<bigint>"
    out = arrow_schema(schema)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in batches:
            minima = np.frombuffer(b"".join(run.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
            flat, at = pa.array(band_names(minima).ravel()), np.arange(len(minima) + 1, dtype=np.int32) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(at), flat).cast(out.field("bands").type)
            yield pa.RecordBatch.from_arrays([run.column("set_key"), run.column("n"), bands], schema=out)

    return sets.mapInArrow(name, schema).select(F.posexplode("bands").alias("at", "band"), "set_key", "n")


def _sizes_fit(n1: Column, n2: Column, least: tuple[int, int]) -> Column:
    return F.least(n1, n2) * least[1] >= F.greatest(n1, n2) * least[0]


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the pairs whose signatures agree in at least ``ESTIMATE`` of their minima."""
    schema = "a bigint, b bigint"
    out = arrow_schema(schema)
    side = lambda x: sets.select(F.col("set_key").alias(x), F.col("signature").alias(f"s{x}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in batches:
            one, two = (
                np.frombuffer(b"".join(run.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sa", "sb")
            )
            keep = pa.array((one == two).sum(1) >= ESTIMATE * HASHES)
            yield pa.RecordBatch.from_arrays([run.column(c).filter(keep) for c in "ab"], schema=out)

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(compare, schema)


def _overlaps(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """a, b, both, total: sizes of intersection and union of each pair, counted on full sets."""
    schema = "a bigint, b bigint, both bigint, total bigint"
    out = arrow_schema(schema)
    side = lambda x: full.select(F.col("set_key").alias(x), F.col("ids").alias(f"ids{x}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in batches:
            both, total = [], []
            for x, y in zip(run.column("idsa").to_pylist(), run.column("idsb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                total.append(len(x) + len(y) - both[-1])
            yield pa.RecordBatch.from_arrays(
                [run.column("a"), run.column("b"), pa.array(both, pa.int64()), pa.array(total, pa.int64())], schema=out
            )

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "idsa", "idsb").mapInArrow(compare, schema)


def _confirmed(pairs: DataFrame, full: DataFrame, least: tuple[int, int]) -> DataFrame:
    """a, b: the pairs linked by their full sets."""
    linked = F.col("both") * least[1] >= F.col("total") * least[0]
    return _overlaps(pairs, full).filter(linked).select("a", "b")


def _fewer_edges(links: DataFrame) -> DataFrame:
    """a, b: edges with the components of the star ``links`` (leader a, member b): a member is
    tied to its first leader only, and that leader to the member's others, once for all
    members that have them in common. A set has as many leaders as bands at most."""
    heads = links.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("heads")).withColumn("a", F.get("heads", F.lit(0)))
    among = heads.filter(F.size("heads") > 1).select("a", F.explode(F.slice("heads", 2, BANDS)).alias("b")).distinct()
    return heads.select("a", "b").unionByName(among)


def _own_shingles(full: DataFrame) -> DataFrame:
    """set_key, own: how many shingles of a set no other of these sets holds."""
    schema = "shingle bigint, set_key bigint"
    out = arrow_schema(schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in batches:
            for part in slices([run], "ids"):
                ids = [np.frombuffer(x, np.int64) for x in part.column("ids").to_pylist()]
                key = np.repeat(part.column("set_key").to_numpy(), [len(x) for x in ids])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(key)], schema=out)

    held = full.select("set_key", "ids").mapInArrow(spread, schema).groupBy("shingle").agg(
        F.min("set_key").alias("set_key"), F.count(F.lit(1)).alias("held")
    )
    return held.filter("held = 1").groupBy("set_key").agg(F.count(F.lit(1)).alias("own"))


def _tiles(members: DataFrame) -> DataFrame:
    """Each member in all tiles of its bucket that its block is part of: low and high are the
    tile's blocks, part tells which of the two it is in, same whether they are one."""
    blocks = F.ceil(F.col("held") / TILE).cast("int")
    return (
        members.withColumn("own_block", F.pmod(F.xxhash64("set_key"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "at", "band", "set_key", "n", "with_leader", "rest", "root", F.least("own_block", "other").alias("low"),
            F.greatest("own_block", "other").alias("high"), (F.col("own_block") > F.col("other")).cast("int").alias("part"),
            (F.col("own_block") == F.col("other")).alias("same"),
        )
    )


def _cross_pairs(members: DataFrame, least: tuple[int, int]) -> DataFrame:
    """a, b: pairs of different classes in a tile whose sizes, shared shingles and signatures
    allow a link, in the first band in which they agree only. ``members``: at, band, low, high,
    part, same, set_key, n, with_leader (shingles of the bucket's leader in the set), rest
    (other shingles that some open set holds too), root, signature."""
    schema = "a bigint, b bigint"
    out = arrow_schema(schema)

    def pairs(table: pa.Table) -> pa.Table:
        key, n, core, rest, root, part = (
            table.column(c).to_numpy() for c in ("set_key", "n", "with_leader", "rest", "root", "part")
        )
        minima = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        left, right = [], []
        diagonal = part.min() == part.max() and table.column("same")[0].as_py()
        at = table.column("at")[0].as_py()
        rows, others = (np.arange(len(key)),) * 2 if diagonal else (np.flatnonzero(part == 0), np.flatnonzero(part == 1))
        for i in rows:
            j = others[others > i] if diagonal else others
            # Both may share what both have of the leader, and of the others' shingles.
            most = np.minimum(core[j], core[i]) + np.minimum(rest[j], rest[i])
            j = j[(root[j] != root[i]) & (most * sum(least) >= (n[j] + n[i]) * least[0])]
            equal = minima[j] == minima[i]
            first = equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == at
            j = j[first & (equal.sum(1) >= ESTIMATE * HASHES)]
            left.append(np.full(len(j), key[i]))
            right.append(key[j])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=out)

    return members.groupBy("at", "band", "low", "high").applyInArrow(pairs, schema)


def minhash_duplicates(docs: DataFrame, width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_key.

    A-Z are lower-cased; a set holds the distinct shingles of ``width`` words, or the whole
    sequence where there are fewer. Sets are linked if their Jaccard similarity is at least
    ``least``, decided on the full sets; for a bound below 0.85 the bands no longer give the
    recall stated above, so it is an error. component_id is the smallest doc_id reachable by
    links, itself included; the row with that doc_id is kept. Null text and text without
    words have no shingles and no links. Null doc_ids are passed over as component_id unless
    the whole class has none; then all its rows are kept. Repeated rows are in one class, and
    each row of the smallest doc_id counts as kept. An empty table gives no rows. Other
    columns are not read. Shingles are compared by 64-bit hashes.
    """
    if least[0] * LEAST[1] < LEAST[0] * least[1]:
        raise ValueError("the bands are laid out for a similarity of 0.85 or more")
    scratch = Scratch(docs.sparkSession, "minhash")
    read = only(docs, "doc_id", "text").select("doc_id", text_key().alias("text_key"), text_or_empty().alias("text"))
    rows = scratch.table(_signed_rows(read, width), "rows")
    sets = scratch.table(
        rows.filter("n > 0").groupBy("set_key").agg(F.first("n").alias("n"), F.first("signature").alias("signature")), "sets"
    )

    # Buckets with one set are gone after this.
    entries = _entries(sets)
    buckets = entries.groupBy("band").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = scratch.table(entries.join(scratch.table(buckets, "buckets"), "band"), "met")
    company = scratch.table(met.groupBy("set_key").agg(F.sum("held").alias("company")), "company")
    members = scratch.table(met.join(company, "set_key"), "members")
    leader = F.max(F.struct("company", "set_key", "n")).alias("leader")
    heads = scratch.table(members.groupBy("band").agg(leader).select("band", "leader.set_key", "leader.n"), "heads")
    heads = heads.select("band", F.col("set_key").alias("leader"), F.col("n").alias("n1"))
    stars = members.join(heads, "band").filter("set_key != leader").filter(_sizes_fit(F.col("n"), F.col("n1"), least))
    stars = stars.select(F.col("leader").alias("a"), F.col("set_key").alias("b")).distinct()
    near = scratch.table(_alike(stars, sets), "near")
    # Written first, so that their size is known when the join is planned: the sets of other
    # texts need no shuffle while these keys are few.
    wanted = scratch.table(near.select(F.col("a").alias("set_key")).union(near.select("b")).distinct(), "wanted")
    full = scratch.table(
        _full_sets(read, width).join(wanted, "set_key", "left_semi").groupBy("set_key").agg(F.first("ids").alias("ids")), "full"
    )
    links = scratch.table(_confirmed(near, full, least), "links")
    roots = scratch.table(components(_fewer_edges(links), scratch, "first"), "first-roots")

    root = F.coalesce("root", "set_key")
    classed = scratch.table(
        members.select("at", "band", "set_key", "n", "held")
        .join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", root),
        "classed",
    )
    several = scratch.table(
        classed.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 < r2").select("band"),
        "several",
    )
    opened = scratch.table(classed.join(several, "band"), "open")
    if not opened.isEmpty():
        wanted = scratch.table(opened.select("set_key").distinct(), "open-sets")
        missing = scratch.table(wanted.join(full, "set_key", "left_anti"), "missing")
        later = _full_sets(read, width).join(missing, "set_key", "left_semi").groupBy("set_key").agg(F.first("ids").alias("ids"))
        full = scratch.table(later.unionByName(full).join(wanted, "set_key", "left_semi"), "open-full")
        own = scratch.table(_own_shingles(full), "own")
        led = opened.join(heads.select("band", "leader"), "band")
        stars = led.filter("set_key != leader").select(F.col("leader").alias("a"), F.col("set_key").alias("b")).distinct()
        held = scratch.table(_overlaps(stars, full), "with-leaders").select(
            F.col("a").alias("leader"), F.col("b").alias("set_key"), F.col("both").alias("with_leader")
        )
        shared = led.join(held, ["leader", "set_key"], "left").join(own, "set_key", "left").withColumn(
            "with_leader", F.coalesce("with_leader", "n")
        ).withColumn("rest", F.col("n") - F.col("with_leader") - F.coalesce("own", F.lit(0)))
        crossing = _cross_pairs(_tiles(shared).join(sets.select("set_key", "signature"), "set_key"), least)
        known = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        unknown = scratch.table(crossing.join(known, ["a", "b"], "left_anti"), "unknown")
        more = scratch.table(_confirmed(unknown, full, least), "more-links")
        both = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
        roots = scratch.table(components(both, scratch, "second"), "second-roots")

    alone = F.when(F.col("n") == 0, F.lit(None)).otherwise(root)
    labelled = scratch.table(
        rows.drop("signature").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", alone),
        "labelled",
    )
    smallest = scratch.table(
        labelled.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest")), "smallest"
    )
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return labelled.join(smallest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key",
    )
