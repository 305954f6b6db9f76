"""Derived columns of a post: engagement, category name, identity, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.patterns import let, present

# --- fixed values ------------------------------------------------------------------------
PLATFORM_NAMES = {"youtube": "YouTube", "reddit": "Reddit", "bluesky": "Bluesky"}
CATEGORY_KEYS = ["category", "name", "label", "primary"]
WATCH_URL = "https://www.youtube.com/watch?v="
PROFILE_URL = "https://bsky.app/profile/"
# ---------------------------------------------------------------------------------------


def total_engagement(
    platform: Column | None = None, engagement: Column | None = None, stored: Column | None = None
) -> Column:
    """Score per platform; ``stored`` is what an unknown platform keeps (0 by default)."""
    platform = F.lower(F.col("platform") if platform is None else platform)
    engagement = F.col("engagement") if engagement is None else engagement
    zero = F.lit(0).cast("bigint")
    n = lambda name: F.coalesce(engagement[name], zero)
    return (
        F.when(platform == "youtube", n("views") + n("likes") + n("comments"))
        .when(
            platform == "reddit",
            F.coalesce(engagement["score"], engagement["likes"], zero) + n("comments"),
        )
        .when(platform == "bluesky", n("likes") + n("reposts") + n("comments"))
        .otherwise(zero if stored is None else F.coalesce(stored, zero))
    )


def category_name(category: Column) -> Column:
    """Plain name of a category stored as text or as JSON.

    Only text that can start a JSON value is parsed, so plain names cost one pattern test.
    """

    def field(parsed: Column, key: str) -> Column:
        part = lambda kind: F.try_variant_get(parsed, f"$.{key}", kind)
        shape = F.schema_of_variant(part("variant"))
        falsy = shape.isin("VOID", "BOOLEAN") & (F.coalesce(part("string"), F.lit("false")) == "false")
        zero = ~shape.isin("STRING") & (part("double") == 0)
        return F.when(
            ~F.coalesce(falsy, F.lit(True)) & ~F.coalesce(zero, F.lit(False)), present(part("string"))
        )

    def name(parsed: Column) -> Column:
        shape = F.schema_of_variant(parsed)
        return (
            F.when(parsed.isNull(), category)
            .when(
                shape.startswith("OBJECT"),
                F.coalesce(*[field(parsed, k) for k in CATEGORY_KEYS], F.lit("")),
            )
            .when(shape.startswith("ARRAY"), F.lit(""))
            .when(shape == "VOID", F.lit("null"))
            .otherwise(F.try_variant_get(parsed, "$", "string"))
        )

    may_be_json = category.rlike(r'^[ \t\r\n]*([\[{"]|-?[0-9]|true|false|null)')
    return (
        F.when(present(category).isNull(), F.lit(""))
        .when(may_be_json, let(F.try_parse_json(category), name))
        .otherwise(category)
    )


def post_key(id_: Column, post_id: Column) -> Column:
    """Identity shown to a reader: the row id, else the platform's own id."""
    return F.coalesce(F.nullif(id_.cast("string"), F.lit("0")), post_id)


def watch_url(video_id: Column) -> Column:
    return F.concat(F.lit(WATCH_URL), video_id)


def profile_url(handle: Column, uri: Column) -> Column:
    """Address of a micro-blog post; null without a handle or a record address."""
    record = F.element_at(F.split(present(uri), "/"), -1)
    return F.concat(F.lit(PROFILE_URL), present(handle), F.lit("/post/"), record)


def microblog_creator(display_name: Column, handle: Column) -> Column:
    return F.coalesce(present(display_name), present(handle))


def feed_creator(creator: Column, author: Column) -> Column:
    return F.coalesce(present(creator), present(author))


def feed_handle(creator: Column) -> Column:
    return F.concat(F.lit("u/"), present(creator))


def platform_name(platform: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PLATFORM_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, platform), platform)
