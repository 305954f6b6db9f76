"""Keyed writes on the posts table, each one a single join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.export import numbered

KEY = ["platform", "post_id"]
KEPT = ["id", "created_at", "updated_at"]


def latest_per_key(batch: DataFrame, order: list[Column], key: list[str] = KEY) -> DataFrame:
    """One row per key: the last by ``order``.

    An aggregate, not a window: re-deliveries of one key are folded before the shuffle,
    however many there are.
    """
    rest = [c for c in batch.columns if c not in key]
    ranked = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return batch.groupBy(*key).agg(ranked).select(*key, "row.*").select(*batch.columns)


def upsert_posts(
    target: DataFrame,
    batch: DataFrame,
    now: Column,
    keep_clusters: bool = False,
    order: list[Column] | None = None,
    base: Column | None = None,
) -> DataFrame:
    """New state of the table after writing ``batch`` on ``(platform, post_id)``.

    Payload columns of the batch overwrite; id, created_at and updated_at of a known key
    stay; ``cluster_id`` becomes null again unless ``keep_clusters``. New rows are numbered
    without gaps above ``base``, the present maximum, in the order of their keys.
    """
    order = order or [F.col("published_at"), F.col("original_text")]
    incoming = latest_per_key(batch.drop(*KEPT), order)
    payload = [c for c in target.columns if c not in KEY + KEPT]
    unknown = batch.select(*KEY).distinct().join(target.select(*KEY), KEY, "left_anti")
    places = numbered(unknown, [F.col(k) for k in KEY], "_place")
    new = incoming.join(places, KEY, "left").select(
        *KEY, "_place", F.struct(*[c for c in payload if c in incoming.columns]).alias("new")
    )
    old = target.select(*KEY, F.struct(*[c for c in target.columns if c not in KEY]).alias("old"))
    joined = old.join(new, KEY, "full_outer")
    arrived = F.col("new").isNotNull()

    def value(name: str) -> Column:
        if name == "id":
            top = F.lit(target.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()) if base is None else base
            return F.coalesce(F.col("old.id"), top + F.col("_place"))
        if name in KEPT:
            return F.when(F.col("old").isNull(), now).otherwise(F.col(f"old.{name}"))
        if name == "cluster_id":
            kept = F.col("old.cluster_id") if keep_clusters else F.lit(None).cast("string")
            return F.when(arrived, kept).otherwise(F.col("old.cluster_id"))
        if name not in incoming.columns:
            return F.col(f"old.{name}")
        return F.when(arrived, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))

    return joined.select(
        *[F.col(c) if c in KEY else value(c).alias(c) for c in target.columns]
    )


def preserve_translations(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Batch rows keep the non-empty translations already stored for their key."""
    saved = existing.filter(F.size("translations") > 0).select(
        *KEY, F.col("translations").alias("_saved")
    )
    joined = batch.join(saved, KEY, "left")
    return joined.withColumn("translations", F.coalesce("_saved", "translations")).select(
        *batch.columns
    )


def apply_clusters(posts: DataFrame, assignment: DataFrame, now: Column) -> DataFrame:
    """Write ``assignment(id, cluster_id)`` back by id and stamp the rows it touches."""
    given = assignment.select("id", F.col("cluster_id").alias("_cluster"))
    joined = posts.join(given, "id", "left")
    hit = F.col("_cluster").isNotNull()
    return joined.select(
        *[
            F.coalesce("_cluster", "cluster_id").alias(c) if c == "cluster_id"
            else F.when(hit, now).otherwise(F.col("updated_at")).alias(c) if c == "updated_at"
            else F.col(c)
            for c in posts.columns
        ]
    )


def put_translations(posts: DataFrame, rows: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Add ``rows(id, language, text)`` to the translation cache, last one per language wins."""
    given = latest_per_key(rows, order or [F.col("text")], ["id", "language"])
    fresh = given.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.lower("language"), "text"))).alias("_new")
    )
    joined = posts.join(fresh, "id", "left")
    untouched = F.map_filter("translations", lambda k, _: ~F.map_contains_key(F.col("_new"), k))
    merged = F.when(F.col("_new").isNull(), F.col("translations")).otherwise(
        F.map_concat(F.coalesce(untouched, F.create_map().cast("map<string,string>")), "_new")
    )
    return joined.withColumn("translations", merged).select(*posts.columns)


def backfill_language(posts: DataFrame, identified: DataFrame) -> DataFrame:
    """Rows whose recomputed language differs from the stored one, with both values.

    ``identified`` carries the full key, so equal post ids of two platforms stay apart.
    """
    joined = posts.join(identified.select(*KEY, "new_language"), KEY)
    return joined.filter(~F.col("language").eqNullSafe(F.col("new_language")))
