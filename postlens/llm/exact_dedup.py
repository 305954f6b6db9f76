"""Exact de-duplication by deterministic block naming.

Each normalised text is cut into blocks of fixed size. The distinct blocks are sorted and
numbered; then adjacent pairs of numbers are numbered in the same way, level by level, until
one number is left. Two texts of as many levels have the same last number exactly if they
are equal: numbers are given to sorted contents, so there are no collisions to trust.

The content of a block travels once, to be sorted. Every occurrence finds its number by a
short key of the content; it is checked on the sorted contents that no two of them share a
key, and other keys are taken if they do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Scratch, ascii_lower, kept_rows, only, text_key, text_or_empty

BLOCK_BYTES = 16 * 1024
ATTEMPTS = 8


def content_keys(block: Column, attempt: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * attempt + i), block) for i in (0, 1)]


def _blocks(content: str, size: int) -> Column:
    last = f"greatest(0, cast((octet_length({content}) - 1) div {size} as int))"
    return F.expr(f"transform(sequence(0, {last}), i -> substring({content}, i * {size} + 1, {size}))")


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower,
    block_bytes: int = BLOCK_BYTES,
    keys: Callable[[Column, int], list[Column]] = content_keys,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_key,
    n_blocks.

    Of equal normalised texts the row with the largest doc_id is kept. Null text counts as
    empty, and all empty texts are equal. A null doc_id is smaller than any other. Of
    repeated rows (same doc_id, equal text) one is kept. An empty table gives no rows; other
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    read = only(docs, "doc_id", text)
    content = read.select(
        "doc_id", text_key(text).alias("text_key"),
        normalise(text_or_empty(text)).cast("binary").alias("content"),
    )

    for attempt in range(ATTEMPTS):
        rows = scratch.table(
            content.select(
                F.monotonically_increasing_id().alias("row"), "doc_id", "text_key",
                F.sha2("content", 256).alias("text_sha256"),
                F.transform(_blocks("content", block_bytes), lambda b: F.struct(
                    *[k.alias(f"k{i}") for i, k in enumerate(keys(b, attempt))]
                )).alias("keys"),
            ).withColumn("n", F.size("keys")),
            f"rows-{attempt}",
        )
        blocks = content.select(F.explode(_blocks("content", block_bytes)).alias("block")).distinct()
        names = scratch.table(
            blocks.sortWithinPartitions("block").select(
                *[k.alias(f"k{i}") for i, k in enumerate(keys(F.col("block"), attempt))],
                F.monotonically_increasing_id().alias("name"),
            ),
            f"names-{attempt}",
        )
        key_columns = [c for c in names.columns if c != "name"]
        if names.groupBy(*key_columns).count().filter("count > 1").isEmpty():
            break
        scratch.drop(f"rows-{attempt}", f"names-{attempt}")
    else:
        raise RuntimeError("no key tells the blocks apart")

    entries = rows.select("row", "n", F.posexplode("keys").alias("pos", "key")).select(
        "row", "n", "pos", "key.*"
    )
    level = scratch.table(entries.join(names, key_columns).select("row", "n", "pos", "name"), "level-0")
    done = [level.filter("n = 1").select("row", F.lit(0).alias("level"), "name")]
    most = rows.agg(F.max("n")).first()[0] or 1
    for depth in range(1, (most - 1).bit_length() + 1):
        pairs = scratch.table(
            level.filter("n > 1")
            .groupBy("row", F.expr("cast((n + 1) div 2 as int) as n"), F.expr("cast(pos div 2 as int) as pos"))
            .agg(
                F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
                F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b"),
            ),
            f"pairs-{depth}",
        )
        named = scratch.table(
            pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
            .withColumn("name", F.monotonically_increasing_id()),
            f"pair-names-{depth}",
        )
        level = scratch.table(
            pairs.join(named, ["a", "b"]).select("row", "n", "pos", "name"), f"level-{depth}"
        )
        done.append(level.filter("n = 1").select("row", F.lit(depth).alias("level"), "name"))

    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    labelled = scratch.table(
        rows.select("row", "doc_id", "text_sha256", "text_key", F.col("n").alias("n_blocks")).join(identity, "row"),
        "labelled",
    )
    groups = scratch.table(
        labelled.groupBy("level", "name").agg(
            F.max(F.struct("doc_id", (-F.col("row")).alias("minus_row"))).alias("top"),
            F.count(F.lit(1)).alias("group_size"),
        ),
        "groups",
    )
    return labelled.join(groups, ["level", "name"]).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == -F.col("top.minus_row")).alias("kept"),
        "text_sha256", "text_key", "n_blocks",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, columns unchanged."""
    return kept_rows(docs, exact_dedup(docs).filter("kept").select("doc_id", "text_key"))
