"""Dashboard statistics and the cluster view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.patterns import present
from postlens.functions.posts import category_name, post_key
from postlens.schema import PLATFORMS

SENTIMENTS = ["Positive", "Neutral", "Negative"]
DEFAULT_HEADER = "Related passport conversation"


def newest_first() -> Column:
    """Feed order as one comparable value: smaller is earlier in the feed."""
    # a missing time sorts before every known one, then newer times before older ones
    age = -F.unix_micros(F.col("published_at").cast("timestamp"))
    return F.struct(
        F.col("published_at").isNotNull().cast("int").alias("dated"),
        F.coalesce(age, F.lit(0)).alias("age"),
        F.col("id").alias("id"),
    )


def dashboard_stats(df: DataFrame) -> DataFrame:
    """Totals in one pass: posts, per platform, per sentiment, engagement sum."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("platform") == p).alias(p) for p in PLATFORMS],
        *[F.count_if(F.col("sentiment") == s).alias(s.lower()) for s in SENTIMENTS],
        F.coalesce(F.sum("total_engagement"), F.lit(0)).alias("engagement"),
    )


def shares(stats: DataFrame) -> DataFrame:
    """Percent of the total per platform and sentiment; 0 when there are no posts."""
    names = PLATFORMS + [s.lower() for s in SENTIMENTS]
    share = lambda n: F.coalesce(F.try_divide(F.col(n) * 100.0, F.col("total")), F.lit(0.0))
    return stats.select(*[share(n).alias(f"{n}_pct") for n in names])


def top_categories(df: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent category names; blanks ignored, ties by first appearance in the feed."""
    named = df.select(category_name(F.col("category")).alias("category"), newest_first().alias("at"))
    counted = named.filter(F.col("category") != "").groupBy("category").agg(
        F.count(F.lit(1)).alias("posts"), F.min("at").alias("first_at")
    )
    return counted.orderBy(F.desc("posts"), "first_at").limit(n).select("category", "posts")


def group_key() -> Column:
    single = F.concat(F.lit("single-"), post_key(F.col("id"), F.col("post_id")))
    return F.coalesce(present(F.col("cluster_id")), single)


def cluster_groups(df: DataFrame) -> DataFrame:
    """One row per group: size, first member and header text.

    Only partial aggregates travel, so a group holding a large share of the posts costs no
    more than any other.
    """
    header = F.coalesce(
        present(F.col("summary")), present(category_name(F.col("category"))), F.lit(DEFAULT_HEADER)
    )
    keyed = df.select(
        group_key().alias("group_key"), newest_first().alias("at"),
        F.col("id").alias("first_id"), header.alias("header"),
    )
    first = F.min(F.struct("at", "first_id", "header")).alias("first")
    return (
        keyed.groupBy("group_key")
        .agg(F.count(F.lit(1)).alias("size"), first)
        .select("group_key", "size", F.col("first.at").alias("first_at"), "first.first_id", "first.header")
    )


def cluster_view(df: DataFrame) -> DataFrame:
    """Posts with their group, groups in order of their first member, members in feed order."""
    members = df.withColumn("group_key", group_key()).withColumn("at", newest_first())
    joined = members.join(cluster_groups(df), "group_key")
    return joined.orderBy("first_at", "at").drop("first_at", "at")


def cluster_preview(df: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` members of every group and how many more there are.

    The rank filter is applied before the shuffle as well (a per-task group limit), so a
    huge group sends at most ``n`` rows per task.
    """
    keyed = df.withColumn("group_key", group_key()).withColumn("at", newest_first())
    window = Window.partitionBy("group_key").orderBy("at")
    top = keyed.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n)
    sizes = keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("size"))
    return top.join(sizes, "group_key").withColumn(
        "more", F.greatest(F.col("size") - n, F.lit(0))
    ).drop("at")


def language_changes(df: DataFrame, old: str = "language", new: str = "new_language") -> DataFrame:
    """Backfill report: one row per ``old -> new`` change with its count."""
    name = lambda c: F.coalesce(present(F.col(c)), F.lit("null"))
    changed = df.filter(~present(F.col(old)).eqNullSafe(present(F.col(new))))
    label = F.concat_ws(" -> ", name(old), name(new)).alias("change")
    return changed.groupBy(label).agg(F.count(F.lit(1)).alias("posts"))


def backfill_totals(df: DataFrame, old: str = "language", new: str = "new_language") -> DataFrame:
    """Backfill report: scanned, changed and unchanged rows."""
    same = present(F.col(old)).eqNullSafe(present(F.col(new)))
    return df.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(~same).alias("changed"),
        F.count_if(same).alias("unchanged"),
    )


def ingest_metrics(raw: DataFrame, source: str = "source") -> DataFrame:
    """Per source: records found, kept as fresh and texted, skipped for lack of text.

    Expects ``is_fresh`` and ``has_text`` per raw record.
    """
    fresh, text = F.col("is_fresh"), F.col("has_text")
    return raw.groupBy(source).agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(fresh & text).alias("processed"),
        F.count_if(fresh & ~text).alias("skipped"),
        F.count_if(fresh & text).alias("saved"),
    )


def cluster_report(df: DataFrame) -> DataFrame:
    """Clustering pass report: posts and distinct clusters."""
    return df.agg(
        F.count(F.lit(1)).alias("posts"), F.count_distinct("cluster_id").alias("clusters")
    )
