"""Feed, search, dashboard filters and orderings as single declarative plans."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.patterns import WS, present
from postlens.functions.posts import category_name, post_key, total_engagement
from postlens.schema import scan_posts

SORT_FIELDS = ["published_at", "created_at", "platform", "category", "engagement"]
TIME_RANGES = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24}


@dataclass(frozen=True)
class FeedOptions:
    """Parameters of a feed request; an absent or empty one adds no predicate."""

    platform: str | None = None
    region: str | None = None
    creator: str | None = None
    language: str | None = None
    category: str | None = None
    sentiment: str | None = None
    time_from: str | datetime | None = None
    time_to: str | datetime | None = None
    last_24h: bool = False
    min_engagement: str | float | None = None
    sort: str = "published_at"
    order: str = "desc"
    as_of: str | datetime | None = None
    q: str | None = None

    @property
    def sort_field(self) -> str:
        return self.sort if self.sort in SORT_FIELDS else "published_at"

    @property
    def ascending(self) -> bool:
        return str(self.order).lower() == "asc"

    def with_time_range(self, preset: str) -> "FeedOptions":
        """Expand a time preset: a day uses the last-24h predicate, longer ones a start time."""
        if preset not in TIME_RANGES:
            return self
        if preset == "24h":
            return replace(self, last_24h=True)
        start = _clock(self.as_of) - timedelta(hours=TIME_RANGES[preset])
        return replace(self, time_from=start)


def _clock(as_of: str | datetime | None) -> datetime:
    if as_of is None:
        raise ValueError("time predicates need an explicit as_of")
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)


def _time(value: str | datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def parse_number(value: str | float | None) -> float | None:
    """Number of a request parameter: blank text is 0, text that is no number gives None."""
    if value is None or isinstance(value, (int, float)):
        return value
    text = re.sub(f"^{WS}+|{WS}+$", "", value)
    if text == "":
        return 0
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", text):
        return int(text, 0)
    if re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", text):
        return float(text)
    if re.fullmatch(r"[+-]?Infinity", text):
        return float(text.replace("Infinity", "inf"))
    return None


def like_pattern(value: str) -> str:
    """``%value%`` with live wildcards; an escape before an ordinary character is dropped."""
    return "%" + re.sub(r"\\([^%_\\])", r"\1", value.replace("*", "%")) + "%"


def visible(df: DataFrame) -> DataFrame:
    """Relevant and not gibberish: what every read path starts from."""
    return df.filter(F.col("is_relevant") & ~F.col("is_gibberish"))


def by_platform(df: DataFrame, platform: str | None) -> DataFrame:
    return df.filter(F.col("platform") == platform.lower()) if platform else df


def by_region(df: DataFrame, region: str | None) -> DataFrame:
    if not region:
        return df
    return df.filter(F.col("region").ilike(like_pattern(re.sub(WS, "", region))))


def by_creator(df: DataFrame, creator: str | None) -> DataFrame:
    if not creator:
        return df
    pattern = like_pattern(creator)
    return df.filter(F.col("creator_name").ilike(pattern) | F.col("creator_handle").ilike(pattern))


def by_language(df: DataFrame, language: str | None) -> DataFrame:
    return df.filter(F.col("language") == language) if language else df


def by_category(df: DataFrame, category: str | None) -> DataFrame:
    return df.filter(F.col("category").ilike(like_pattern(category))) if category else df


def by_sentiment(df: DataFrame, sentiment: str | None) -> DataFrame:
    return df.filter(F.col("sentiment") == sentiment) if sentiment else df


def by_time(df: DataFrame, time_from=None, time_to=None) -> DataFrame:
    if time_from:
        df = df.filter(F.col("published_at") >= _time(time_from))
    if time_to:
        df = df.filter(F.col("published_at") <= _time(time_to))
    return df


def by_last_24h(df: DataFrame, as_of: str | datetime) -> DataFrame:
    return by_time(df, time_from=_clock(as_of) - timedelta(hours=24))


def with_engagement(df: DataFrame) -> DataFrame:
    return df.withColumn("total_engagement", total_engagement())


def by_min_engagement(df: DataFrame, minimum: str | float | None) -> DataFrame:
    """Keep posts scoring at least ``minimum``; a parameter that is no number is ignored."""
    number = parse_number(minimum)
    return df if number is None else df.filter(F.col("total_engagement") >= F.lit(number))


def filtered(df: DataFrame, options: FeedOptions) -> DataFrame:
    """All predicates of a feed request, unsorted, with ``total_engagement``."""
    out = visible(scan_posts(df))
    out = by_platform(out, options.platform)
    out = by_region(out, options.region)
    out = by_creator(out, options.creator)
    out = by_language(out, options.language)
    out = by_category(out, options.category)
    out = by_sentiment(out, options.sentiment)
    out = by_time(out, options.time_from, options.time_to)
    if options.last_24h:
        out = by_last_24h(out, options.as_of)
    return by_min_engagement(with_engagement(out), options.min_engagement)


def feed_order(options: FeedOptions) -> list[Column]:
    """Order of the feed: missing values first when descending, last when ascending."""
    name = "total_engagement" if options.sort_field == "engagement" else options.sort_field
    col = F.col(name)
    return [col.asc_nulls_last() if options.ascending else col.desc_nulls_first(), F.col("id").asc()]


def feed(df: DataFrame, options: FeedOptions = FeedOptions()) -> DataFrame:
    """Feed request: predicates, engagement threshold and order in one plan."""
    return filtered(df, options).orderBy(*feed_order(options))


def feed_summary(df: DataFrame, options: FeedOptions = FeedOptions()) -> DataFrame:
    """One row: number of posts and the filters that were applied."""
    echo = {
        "platform": options.platform, "region": options.region, "creator": options.creator,
        "language": options.language, "category": options.category,
        "sentiment": options.sentiment,
        "min_engagement": None if options.min_engagement in (None, "") else str(options.min_engagement),
        "time_from": options.time_from and str(options.time_from),
        "time_to": options.time_to and str(options.time_to),
    }
    counted = filtered(df, options).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        "count",
        *[F.lit(v or None).cast("string").alias(k) for k, v in echo.items()],
        F.lit(options.last_24h).alias("last_24h"),
        F.lit(options.sort_field).alias("sort"),
        F.lit("asc" if options.ascending else "desc").alias("order"),
    )


def matches(term: str) -> Column:
    """Literal, case-insensitive substring of text, summary or any saved translation."""
    needle = F.lit(term.strip().lower())
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), needle)
    values = F.coalesce(F.map_values("translations"), F.array().cast("array<string>"))
    return holds(F.col("original_text")) | holds(F.col("summary")) | F.exists(values, holds)


def search(df: DataFrame, q: str) -> DataFrame:
    """Keyword search over the visible posts, newest first; a blank query is an error."""
    if not q or not q.strip():
        raise ValueError("Search query is required")
    hits = with_engagement(visible(scan_posts(df)).filter(matches(q)))
    return hits.orderBy(*feed_order(FeedOptions()))


def fresh(df: DataFrame, as_of: str | datetime, published: str = "published_at") -> DataFrame:
    """Ingest freshness: dated within 24 hours before ``as_of`` and carrying text."""
    return df.filter(is_fresh(as_of, published) & has_text())


def is_fresh(as_of: str | datetime, published: str = "published_at") -> Column:
    start = _time(_clock(as_of) - timedelta(hours=24))
    return F.coalesce(F.col(published) >= start, F.lit(False))


def has_text(text: str = "original_text") -> Column:
    return present(F.regexp_replace(F.col(text), f"{WS}+", "")).isNotNull()


def _dashboard_time() -> Column:
    return F.coalesce(F.col("published_at"), F.col("created_at"), _time("1970-01-01 00:00:00"))


def refine(
    df: DataFrame,
    platform: str = "All",
    category: str = "All",
    sentiment: str = "All",
    language: str = "All",
    region: str = "",
    creator: str = "",
    min_engagement: float = 0,
    time_range: str = "All",
    as_of: str | datetime | None = None,
) -> DataFrame:
    """Dashboard re-filter of a result that already carries ``total_engagement``.

    Differs from the feed filters: the category name must be equal, sentiment and language
    ignore case, white space is dropped on both sides of the region test, and the creator
    is looked for in name and handle joined by a blank.
    """
    same = lambda name, wanted: F.lower(F.coalesce(F.col(name), F.lit(""))) == wanted.lower()
    if platform != "All":
        df = df.filter(same("platform", platform))
    if category != "All":
        df = df.filter(category_name(F.col("category")) == category)
    if sentiment != "All":
        df = df.filter(same("sentiment", sentiment))
    if language != "All":
        df = df.filter(same("language", language))
    if region.strip():
        stored = F.regexp_replace(F.lower(F.coalesce(F.col("region"), F.lit(""))), WS, "")
        df = df.filter(F.contains(stored, F.lit(re.sub(WS, "", region.lower()))))
    if creator.strip():
        both = F.concat(
            F.coalesce(F.col("creator_name"), F.lit("")), F.lit(" "),
            F.coalesce(F.col("creator_handle"), F.lit("")),
        )
        df = df.filter(F.contains(F.lower(both), F.lit(creator.strip().lower())))
    if min_engagement > 0:
        df = df.filter(F.col("total_engagement") >= min_engagement)
    if time_range != "All":
        hours = TIME_RANGES.get(time_range, TIME_RANGES["30d"])
        df = df.filter(_dashboard_time() >= _time(_clock(as_of) - timedelta(hours=hours)))
    return df


def _rank_time(name: str) -> Column:
    return F.coalesce(F.col(name), _time("1970-01-01 00:00:00"))


def export_order(sort: str = "published_at", order: str = "desc") -> list[Column]:
    """Export order: a missing time counts as the epoch, names compare in lower case, and
    ties go by identity as text, ascending in both directions."""
    field = sort if sort in SORT_FIELDS else "published_at"
    if field == "engagement":
        key = F.coalesce(F.col("total_engagement"), F.lit(0))
    elif field == "platform":
        key = F.lower(F.coalesce(F.col("platform"), F.lit("")))
    elif field == "category":
        key = F.lower(category_name(F.col("category")))
    else:
        key = _rank_time(field)
    tie = post_key(F.col("id"), F.col("post_id")).asc()
    return [key.asc() if str(order).lower() == "asc" else key.desc(), tie]


def dashboard_order(sort: str = "published_at-desc") -> list[Column]:
    """Dashboard order ``field-direction``: engagement or a time column, ties as in exports."""
    field, _, direction = sort.partition("-")
    key = F.coalesce(F.col("total_engagement"), F.lit(0)) if field == "engagement" else _rank_time(field)
    tie = post_key(F.col("id"), F.col("post_id")).asc()
    return [key.desc() if direction == "desc" else key.asc(), tie]


def page(df: DataFrame, offset: int = 0, size: int = 500) -> DataFrame:
    """One page by position. Deep positions cost as much as all pages before them."""
    return df.orderBy("id").offset(offset).limit(size)


def page_after(df: DataFrame, last_id: int | None, size: int = 500) -> DataFrame:
    """The page that follows ``last_id``: a pushed-down filter, equally cheap at any depth."""
    rest = df if last_id is None else df.filter(F.col("id") > last_id)
    return rest.orderBy("id").limit(size)
