"""Exports: the fixed-column table and the numbered report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.patterns import present
from postlens.functions.posts import category_name
from postlens.operators.feed import FeedOptions, export_order, filtered, matches
from postlens.session import checkpoint

EXPORT_FIELDS = [
    "platform", "post_id", "creator_name", "creator_handle", "original_text", "post_url",
    "published_at", "language", "region", "category", "sentiment", "total_engagement", "summary",
]
REPORT_TITLE = "Posts report"


def exportable(df: DataFrame, options: FeedOptions = FeedOptions()) -> DataFrame:
    """Posts an export covers: the feed filters plus an optional search term."""
    hits = filtered(df, options)
    return hits.filter(matches(options.q)) if options.q and options.q.strip() else hits


def export_table(df: DataFrame, options: FeedOptions = FeedOptions()) -> DataFrame:
    """The thirteen export columns in export order, categories as plain names."""
    ordered = exportable(df, options).orderBy(*export_order(options.sort, options.order))
    return ordered.withColumn("category", category_name(F.col("category"))).select(*EXPORT_FIELDS)


def export_csv(df: DataFrame, path: str, options: FeedOptions = FeedOptions()) -> None:
    """Write the export as CSV. The part files are ranges of the order, read them by name."""
    export_table(df, options).write.mode("overwrite").csv(
        path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue=None
    )


def numbered(df: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """Dense numbers over a total order without one task seeing all rows.

    The rows are split into ranges of the order and made durable, each range numbers its own
    rows, and the ranges' sizes (one row per partition) give the offsets.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = checkpoint(ranged)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition of the table: the window only adds up these few counts
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = ranged.withColumn("_local", local).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_local")).drop(
        "_part", "_local", "_before"
    )


def report_block(seq: Column) -> Column:
    """Text block of one post in the report."""
    labelled = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    return F.concat_ws(
        "\n",
        F.concat(seq.cast("string"), F.lit(". "), F.col("platform")),
        labelled("Creator", F.coalesce(present(F.col("creator_name")), F.lit("Unknown"))),
        labelled("Category", present(category_name(F.col("category")))),
        labelled("Sentiment", present(F.col("sentiment"))),
        labelled("Engagement", F.col("total_engagement").cast("string")),
        F.coalesce(present(F.col("original_text")), F.lit("No content")),
        labelled("Summary", present(F.col("summary"))),
        labelled("URL", present(F.col("post_url"))),
    )


def export_report(
    df: DataFrame, options: FeedOptions = FeedOptions(), title: str = REPORT_TITLE
) -> DataFrame:
    """``(seq, block)`` rows: a header with title and count, then one block per post."""
    rows = numbered(exportable(df, options), export_order(options.sort, options.order))
    blocks = rows.select("seq", report_block(F.col("seq")).alias("block"))
    header = blocks.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).cast("bigint").alias("seq"),
        F.concat(F.lit(f"{title}\nPosts exported: "), F.col("n").cast("string")).alias("block"),
    )
    return header.unionByName(blocks).orderBy("seq")
