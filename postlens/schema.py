"""Fixed schemas of the curated table and of the landed platform payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLATFORMS = ["youtube", "reddit", "bluesky"]

ENGAGEMENT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("views", "likes", "comments", "reposts", "score")]
)
TRANSLATIONS = T.MapType(T.StringType(), T.StringType())

# Read-path columns of the posts table, in order (raw_data is never read back).
POST_COLUMNS = [
    "id", "platform", "post_id", "creator_name", "creator_handle", "original_text",
    "post_url", "published_at", "language", "region", "category", "sentiment", "summary",
    "is_gibberish", "is_relevant", "cluster_id", "engagement", "translations",
    "created_at", "updated_at",
]

POSTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("platform", T.StringType(), False),
        T.StructField("post_id", T.StringType(), False),
        T.StructField("creator_name", T.StringType()),
        T.StructField("creator_handle", T.StringType()),
        T.StructField("original_text", T.StringType()),
        T.StructField("post_url", T.StringType()),
        T.StructField("published_at", T.TimestampNTZType()),
        T.StructField("language", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("is_gibberish", T.BooleanType()),
        T.StructField("is_relevant", T.BooleanType()),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("engagement", ENGAGEMENT),
        T.StructField("translations", TRANSLATIONS),
        T.StructField("raw_data", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

VIDEO_ITEM = (
    "struct<id:struct<videoId:string>,snippet:struct<title:string,description:string,"
    "channelTitle:string,channelId:string,publishedAt:string>>"
)
VIDEO_STATS = (
    "struct<id:string,snippet:struct<description:string>,"
    "statistics:struct<viewCount:string,likeCount:string,commentCount:string>>"
)
MICROBLOG_POST = (
    "struct<uri:string,indexedAt:string,likeCount:bigint,replyCount:bigint,repostCount:bigint,"
    "record:struct<text:string,createdAt:string>,author:struct<handle:string,displayName:string>>"
)
FEED_ITEM = (
    "struct<guid:string,id:string,link:string,title:string,content:string,contentSnippet:string,"
    "creator:string,author:string,isoDate:string,pubDate:string>"
)


def as_schema(ddl: str) -> T.StructType:
    """Parse one of the payload DDL strings above into a StructType."""
    return T.DataType.fromDDL(ddl)


def scan_posts(df: DataFrame) -> DataFrame:
    """Read-path projection: every posts column but the raw payload."""
    return df.select(*POST_COLUMNS)


def scan_platforms(df: DataFrame, platforms: list[str] = PLATFORMS) -> DataFrame:
    """Rows of the listed platforms; prunes partitions on a table partitioned by platform."""
    return df.filter(F.col("platform").isin(platforms))
