"""SimHash fingerprints and radius search over permuted block tables, in DataFrame functions.

Every occurrence of a term, a pair of neighbouring words, votes with the bits of its hash:
so a term weighs as often as it occurs. A bit of the fingerprint is set where more than half
of the weight has it. Votes for two bits share one long sum.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.llm.common import Scratch, only, shuffle_partitions, text_or_empty

BITS = 128
RADIUS = 3
#: Quantiles of doc_id that the even split is based on, at most.
KNOTS = 256

_LOW = (1 << 32) - 1


def _words(text: str) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def terms(text: str) -> Column:
    """Hashes of neighbouring word pairs, the last word's with nothing; empty without words."""
    words = F.transform(_words(text), lambda w: F.xxhash64(w))
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _votes() -> list[Column]:
    """Sums of bit i and bit i + 32 of each of two hashes of a term."""
    pair = (1 << 32) | 1
    hashes = {"a": F.col("term"), "b": F.xxhash64(F.lit(1), F.col("term"))}
    return [
        F.sum(F.when(F.col("term").isNotNull(), F.shiftrightunsigned(h, i).bitwiseAND(pair))).alias(f"{k}{i}")
        for k, h in hashes.items() for i in range(32)
    ]


def _half(k: str) -> Column:
    """64 bits of the fingerprint, as hexadecimal digits."""
    bits = F.lit(0)
    for i in range(32):
        votes = F.coalesce(F.col(f"{k}{i}"), F.lit(0))
        for bit, n in ((i, votes.bitwiseAND(_LOW)), (i + 32, F.shiftrightunsigned(votes, 32))):
            mask = 1 << bit
            set_bit = F.lit(mask - (1 << 64) if bit == 63 else mask)
            bits = bits.bitwiseOR(F.when(n * 2 > F.col("n_terms"), set_bit).otherwise(F.lit(0).cast("bigint")))
    return F.lower(F.lpad(F.hex(bits.cast("bigint")), 16, "0"))


def hamming(x: Column, y: Column) -> Column:
    """Differing bits of two fingerprints."""
    part = lambda c, i: F.conv(F.substring(c, 1 + 16 * i, 16), 16, -10).cast("bigint")
    return F.bit_count(part(x, 0).bitwiseXOR(part(y, 0))) + F.bit_count(part(x, 1).bitwiseXOR(part(y, 1)))


def likeness(x: Column, y: Column) -> Column:
    return 1 - hamming(x, y) / F.lit(float(BITS))


def _bucket(keys: DataFrame, buckets: int) -> Column | None:
    """An ordered, about even split of ``key``: quantiles, and equal widths between them."""
    knots = min(buckets, KNOTS)
    found = keys.agg(F.percentile_approx("key", [i / knots for i in range(knots + 1)], 100 * knots)).first()[0]
    if not found:
        return None
    found = sorted(set(found))
    each = -(-buckets // knots)
    marks = F.array(*[F.lit(k) for k in found])
    # The interval's number, 1 at least; the last knot closes the last interval.
    k = F.greatest(F.lit(1), F.least(F.size(F.filter(marks, lambda m: m <= F.col("key"))), F.lit(max(1, len(found) - 1))))
    low = F.element_at(marks, k).cast("double")
    high = F.element_at(marks, F.least(k + 1, F.lit(len(found)))).cast("double")
    part = F.floor((F.col("key").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * each)
    return (k * each + F.greatest(F.lit(0), F.least(F.lit(each - 1), part))).cast("int")


def _next_first(rows: DataFrame, column: str) -> DataFrame:
    """bucket, after: ``column`` of the first row of the next bucket; after the last bucket,
    of the first. ``rows`` has one row per bucket."""
    order = Window.orderBy("bucket")  # as many rows as there are buckets
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("bucket", F.coalesce(F.lead(column).over(order), F.first(column).over(everything)).alias("after"))


def fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_near.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the
    next document's first ones (ascending doc_id, equal ids by text, null ids first; the
    first document follows the last). Null text counts as empty; a text without words has
    the fingerprint of zeros. n_near counts, for ids divisible by 50, the documents with a
    fingerprint within ``radius`` bits, itself included; it is null for others. An empty
    table gives no rows. Other columns are not read. doc_id must be a number, or text of one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    read = only(docs, "doc_id", "text").select(
        "doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("key"), text_or_empty().alias("text")
    )
    bucket = _bucket(read, shuffle_partitions(spark))
    if bucket is None:
        bucket = F.lit(0)
    placed = read.withColumn("bucket", bucket)

    # The first text of each bucket, one row per bucket, closes the bucket before.
    least = scratch.table(placed.groupBy("bucket").agg(F.min("key").alias("key")), "least")
    first = placed.join(F.broadcast(least), ["bucket", "key"]).groupBy("bucket").agg(F.min("text").alias("text"))
    after = scratch.table(_next_first(scratch.table(first, "first"), "text"), "after")

    order = Window.partitionBy("bucket").orderBy("key", "text")
    n, half = F.length("text"), F.expr("length(text) div 2").cast("int")
    rows = (
        placed.select("bucket", "doc_id", "text", F.row_number().over(order).alias("nth"), F.lead("text").over(order).alias("next"))
        .join(after, "bucket", "left")
        .select(
            "bucket", "nth", "doc_id", n.cast("bigint").alias("n_chars"), "text",
            F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", "after"), F.lit(1), half)).alias("edited"),
        )
        .withColumn("sha", F.sha2("edited", 256))
    )
    sha = [F.conv(F.substring("sha", 1 + 16 * i, 16), 16, -10).cast("bigint").alias(f"sha{i}") for i in range(4)]
    # Both texts of a document are rows of one bucket, so their terms are summed in place.
    both = rows.select(
        "bucket", "nth", "doc_id", "n_chars", *sha, F.posexplode(F.array("text", "edited")).alias("kind", "t")
    )
    voted = (
        both.select("bucket", "nth", "kind", "doc_id", "n_chars", *[f"sha{i}" for i in range(4)], F.explode_outer(terms("t")).alias("term"))
        .groupBy("bucket", "nth", "kind")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"),
            *[F.max(f"sha{i}").alias(f"sha{i}") for i in range(4)], F.count("term").alias("n_terms"), *_votes(),
        )
    )
    printed = scratch.table(
        voted.select(
            "bucket", "nth", "kind", "doc_id", "n_chars",
            F.concat(*[F.lower(F.lpad(F.hex(f"sha{i}"), 16, "0")) for i in range(4)]).alias("edited_sha256"),
            F.concat(_half("a"), _half("b")).alias("fingerprint"),
        ),
        "printed",
    )
    own = printed.filter("kind = 0").drop("kind")
    edited = printed.filter("kind = 1").select("bucket", "nth", F.col("fingerprint").alias("edited_fingerprint"))
    order = Window.partitionBy("bucket").orderBy("nth")
    closing = scratch.table(_next_first(own.filter("nth = 1").select("bucket", "fingerprint"), "fingerprint"), "closing")
    results = scratch.table(
        own.join(edited, ["bucket", "nth"]).withColumn("next", F.lead("fingerprint").over(order)).join(closing, "bucket", "left")
        .select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.coalesce("next", "after")).alias("near_next"),
        ),
        "results",
    )

    asked = F.col("doc_id") % 50 == 0
    classes = scratch.table(results.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("held")), "classes")
    queries = results.filter(asked).select("fingerprint").distinct()
    near = scratch.table(
        within(classes, queries, radius).join(classes.withColumnRenamed("fingerprint", "found"), "found")
        .groupBy("fingerprint").agg(F.sum("held").alias("n_near")),
        "near",
    )
    return results.join(near, "fingerprint", "left").select(
        *results.columns, F.when(asked, F.col("n_near")).alias("n_near")
    )


def _keys(radius: int, digits: int = BITS // 4) -> Column:
    """One key per permuted table. The digits are cut into ``radius`` + 2 blocks; two
    fingerprints within the radius agree in two blocks at least, and each table has another
    two in front as its key."""
    count = radius + 2
    edges = [digits * i // count for i in range(count + 1)]
    block = [F.substring("fingerprint", a + 1, b - a) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.concat(F.lit(f"{i}.{j}:"), block[i], block[j]) for i, j in combinations(range(count), 2)])


def within(fingerprints: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(fingerprint, found): for each distinct fingerprint of ``queries`` all of
    ``fingerprints`` that differ from it in ``radius`` bits at most. Both are distinct."""
    table = fingerprints.select(F.col("fingerprint").alias("found"), F.explode(_keys(radius)).alias("key"))
    wanted = queries.select("fingerprint", F.explode(_keys(radius)).alias("key"))
    near = wanted.join(table, "key").filter(hamming(F.col("fingerprint"), F.col("found")) <= radius)
    return near.select("fingerprint", "found").distinct()
