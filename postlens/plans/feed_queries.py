"""Scans, filters, projections, orderings, statistics and writes over the posts view."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.language import LANGUAGE_NAMES, with_language_name
from postlens.functions.posts import (
    category_name, feed_creator, feed_handle, microblog_creator, platform_name, post_key,
    profile_url, watch_url,
)
from postlens.operators import export, feed, stats, upsert
from postlens.operators.clusters import cluster_input
from postlens.operators.feed import FeedOptions
from postlens.plans.fixture import AS_OF, posts
from postlens.plans.registry import query
from postlens.schema import scan_platforms, scan_posts

VISIBLE = "is_relevant AND NOT is_gibberish"
ENGAGEMENT = """CASE platform WHEN 'youtube' THEN views + likes + comments
 WHEN 'reddit' THEN coalesce(score, likes, 0) + comments
 WHEN 'bluesky' THEN likes + reposts + comments ELSE 0 END"""
CATEGORY = """CASE WHEN category IS NULL THEN ''
 WHEN starts_with(category, '{') THEN coalesce(nullif(json_extract_string(category, '$.category'), ''), '')
 WHEN starts_with(category, '"') THEN json_extract_string(category, '$')
 ELSE category END"""
FEED_ORDER = "published_at DESC NULLS FIRST, id"


def flat(df):
    """Scalar columns of a posts result, so that any engine can compare them."""
    counters = [F.col(f"engagement.{c}").alias(c) for c in ("views", "likes", "comments", "reposts", "score")]
    cached = [F.col("translations")[k].alias(f"tr_{k}") for k in ("hindi", "english")]
    rest = [c for c in df.columns if c not in ("engagement", "translations", "updated_at")]
    return df.select(*rest, *counters, *cached)


def keyed(df, *extra):
    return df.select("id", *extra)


# --- scans -------------------------------------------------------------------------------
@query("s1_posts_scan", "SELECT * FROM posts")
def _(spark, d):
    return flat(scan_posts(posts(spark, d)))


@query("s7_platform_scan", """SELECT id, platform, language FROM posts
 WHERE platform IN ('youtube', 'reddit', 'bluesky')""")
def _(spark, d):
    return scan_platforms(posts(spark, d)).select("id", "platform", "language")


@query("s8_cluster_input", f"""SELECT row_number() OVER (ORDER BY {FEED_ORDER}) AS seq, id,
 original_text, summary, category, cluster_id FROM posts WHERE {VISIBLE}""")
def _(spark, d):
    rows = export.numbered(cluster_input(posts(spark, d)), feed.feed_order(FeedOptions()))
    return rows.select("seq", "id", "original_text", "summary", "category", "cluster_id")


# --- predicates --------------------------------------------------------------------------
def _predicate(name, options, where, extra=()):
    columns = ", ".join(["id", "platform", "published_at", *extra])
    sql = f"""SELECT {columns}, CAST({ENGAGEMENT} AS BIGINT) AS total_engagement
 FROM posts WHERE {VISIBLE} AND {where}"""

    @query(name, sql)
    def run(spark, d):
        out = feed.filtered(posts(spark, d), options)
        return out.select("id", "platform", "published_at", *extra, "total_engagement")


_predicate("f1_visible", FeedOptions(), "true")
_predicate("f2_platform", FeedOptions(platform="YouTube"), "platform = 'youtube'")
_predicate("f3_region", FeedOptions(region="united  st_tes"), "region ILIKE '%unitedst_tes%'", ("region",))
_predicate(
    "f4_creator", FeedOptions(creator="SRC1"),
    "(creator_name ILIKE '%SRC1%' OR creator_handle ILIKE '%SRC1%')", ("creator_handle",),
)
_predicate("f5_language", FeedOptions(language="fra"), "language = 'fra'", ("language",))
_predicate("f6_category", FeedOptions(category="SCAM"), "category ILIKE '%SCAM%'", ("category",))
_predicate("f7_sentiment", FeedOptions(sentiment="Positive"), "sentiment = 'Positive'", ("sentiment",))
_predicate(
    "f8_time_range",
    FeedOptions(time_from="2024-01-01 06:00:00", time_to="2024-01-03 00:00:00"),
    "published_at >= TIMESTAMP '2024-01-01 06:00:00' AND published_at <= TIMESTAMP '2024-01-03 00:00:00'",
)
_predicate(
    "f9_last_24h",
    FeedOptions(last_24h=True, time_to="2024-01-02 06:00:00", as_of=AS_OF),
    f"""published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS
 AND published_at <= TIMESTAMP '2024-01-02 06:00:00'""",
)
_predicate("f10_min_engagement", FeedOptions(min_engagement="900"), f"{ENGAGEMENT} >= 900")
_predicate(
    "f15_time_preset_7d", FeedOptions(as_of=AS_OF).with_time_range("7d"),
    f"published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS",
)


@query("f11_feed", f"""SELECT id, platform, region, category, sentiment, published_at,
 CAST({ENGAGEMENT} AS BIGINT) AS total_engagement FROM posts
 WHERE {VISIBLE} AND platform = 'bluesky' AND region ILIKE '%united%'
 AND sentiment = 'Neutral' AND language = 'eng'
 AND published_at >= TIMESTAMP '2024-01-01 00:00:00' AND {ENGAGEMENT} >= 100""")
def _(spark, d):
    options = FeedOptions(
        platform="Bluesky", region="United", sentiment="Neutral", language="eng",
        time_from="2024-01-01 00:00:00", min_engagement="100", sort="engagement",
    )
    return feed.feed(posts(spark, d), options).select(
        "id", "platform", "region", "category", "sentiment", "published_at", "total_engagement"
    )


@query("f12_search", f"""SELECT id, CAST({ENGAGEMENT} AS BIGINT) AS total_engagement FROM posts
 WHERE {VISIBLE} AND (contains(lower(original_text), 'the in') OR contains(lower(coalesce(summary, '')), 'the in')
 OR contains(lower(coalesce(tr_hindi, '')), 'the in') OR contains(lower(coalesce(tr_english, '')), 'the in'))""")
def _(spark, d):
    return feed.search(posts(spark, d), "  The IN ").select("id", "total_engagement")


@query("f13_fresh", f"""SELECT id, published_at FROM posts
 WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS AND trim(original_text) <> ''""")
def _(spark, d):
    return feed.fresh(posts(spark, d), AS_OF).select("id", "published_at")


@query("f14_dashboard_refine", f"""SELECT id, region, language, sentiment,
 CAST({ENGAGEMENT} AS BIGINT) AS total_engagement FROM posts
 WHERE {VISIBLE} AND {CATEGORY} = 'Scams/Fraud' AND lower(sentiment) = 'neutral'
 AND lower(language) = 'eng' AND contains(lower(coalesce(region, '')), 'canada')
 AND contains(lower(coalesce(creator_name, '') || ' ' || coalesce(creator_handle, '')), 'src')
 AND {ENGAGEMENT} >= 50
 AND coalesce(published_at, created_at) >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS""")
def _(spark, d):
    everything = feed.filtered(posts(spark, d), FeedOptions())
    out = feed.refine(
        everything, category="Scams/Fraud", sentiment="neutral", language="ENG",
        region=" Can ada", creator="SRC", min_engagement=50, time_range="30d", as_of=AS_OF,
    )
    return out.select("id", "region", "language", "sentiment", "total_engagement")


# --- projections -------------------------------------------------------------------------
@query("p1_total_engagement", f"SELECT id, platform, CAST({ENGAGEMENT} AS BIGINT) AS total_engagement FROM posts")
def _(spark, d):
    return keyed(feed.with_engagement(posts(spark, d)), "platform", "total_engagement")


@query("p2_category_name", f"SELECT id, {CATEGORY} AS category_name FROM posts")
def _(spark, d):
    return keyed(posts(spark, d), category_name(F.col("category")).alias("category_name"))


@query("p3_post_key", """SELECT id, CASE WHEN id = 0 THEN post_id ELSE CAST(id AS VARCHAR) END AS post_key
 FROM posts""")
def _(spark, d):
    return keyed(posts(spark, d), post_key(F.col("id"), F.col("post_id")).alias("post_key"))


@query("p4_post_urls", """SELECT id, 'https://www.youtube.com/watch?v=' || post_id AS watch,
 CASE WHEN post_url IS NULL THEN NULL ELSE 'https://bsky.app/profile/' || creator_handle || '/post/'
   || CAST(id AS VARCHAR) END AS profile FROM posts""")
def _(spark, d):
    return keyed(
        posts(spark, d), watch_url(F.col("post_id")).alias("watch"),
        profile_url(F.col("creator_handle"), F.col("post_url")).alias("profile"),
    )


@query("p5_creators", """SELECT id, coalesce(creator_name, creator_handle) AS shown,
 coalesce(creator_name, creator_handle) AS feed_name, 'u/' || creator_name AS feed_handle FROM posts""")
def _(spark, d):
    name, handle = F.col("creator_name"), F.col("creator_handle")
    return keyed(
        posts(spark, d), microblog_creator(name, handle).alias("shown"),
        feed_creator(name, handle).alias("feed_name"), feed_handle(name).alias("feed_handle"),
    )


@query("p6_feed_summary", f"""SELECT count(*) AS count, 'YouTube' AS platform,
 CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS creator, CAST(NULL AS VARCHAR) AS language,
 CAST(NULL AS VARCHAR) AS category, CAST(NULL AS VARCHAR) AS sentiment, '10' AS min_engagement,
 CAST(NULL AS VARCHAR) AS time_from, CAST(NULL AS VARCHAR) AS time_to, false AS last_24h,
 'engagement' AS sort, 'asc' AS "order" FROM posts
 WHERE {VISIBLE} AND platform = 'youtube' AND {ENGAGEMENT} >= 10""")
def _(spark, d):
    options = FeedOptions(platform="YouTube", min_engagement="10", sort="engagement", order="ASC")
    return feed.feed_summary(posts(spark, d), options)


@query("p9_platform_name", """SELECT id, CASE platform WHEN 'youtube' THEN 'YouTube'
 WHEN 'reddit' THEN 'Reddit' WHEN 'bluesky' THEN 'Bluesky' END AS platform_name FROM posts""")
def _(spark, d):
    return keyed(posts(spark, d), platform_name(F.col("platform")).alias("platform_name"))


_NAME_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in LANGUAGE_NAMES.items())


@query("p10_language_name", f"""WITH names(code, name) AS (VALUES {_NAME_ROWS})
 SELECT id, coalesce(n.name, language, '') AS language_name
 FROM posts LEFT JOIN names n ON lower(trim(language)) = n.code""")
def _(spark, d):
    return keyed(with_language_name(posts(spark, d)), "language_name")


# --- orderings: a dense number makes the order part of the compared result ----------------
def _ordered(name, order_cols, order_sql):
    sql = f"""SELECT row_number() OVER (ORDER BY {order_sql}) AS seq, id,
 CAST({ENGAGEMENT} AS BIGINT) AS total_engagement FROM posts WHERE {VISIBLE}"""

    @query(name, sql)
    def run(spark, d):
        rows = feed.filtered(posts(spark, d), FeedOptions())
        return export.numbered(rows, order_cols()).select("seq", "id", "total_engagement")


_EPOCH = "coalesce(published_at, TIMESTAMP '1970-01-01 00:00:00')"
_TIE = "CASE WHEN id = 0 THEN post_id ELSE CAST(id AS VARCHAR) END"
_ordered("so1_feed_sort_published", lambda: feed.feed_order(FeedOptions()), FEED_ORDER)
_ordered(
    "so1_feed_sort_category", lambda: feed.feed_order(FeedOptions(sort="category", order="asc")),
    "category ASC NULLS LAST, id",
)
_ordered(
    "so2_feed_sort_engagement", lambda: feed.feed_order(FeedOptions(sort="engagement")),
    f"{ENGAGEMENT} DESC, id",
)
_ordered("so3_export_sort_published", lambda: feed.export_order(), f"{_EPOCH} DESC, {_TIE}")
_ordered(
    "so3_export_sort_category", lambda: feed.export_order("category", "asc"),
    f"lower({CATEGORY}), {_TIE}",
)
_ordered("so4_dashboard_sort", lambda: feed.dashboard_order("engagement-desc"), f"{ENGAGEMENT} DESC, {_TIE}")


@query("so6_page", "SELECT id, platform FROM posts ORDER BY id LIMIT 50 OFFSET 100")
def _(spark, d):
    return feed.page(posts(spark, d), offset=100, size=50).select("id", "platform")


@query("so6_page_after", "SELECT id, platform FROM posts WHERE id > 99 ORDER BY id LIMIT 500")
def _(spark, d):
    return feed.page_after(posts(spark, d), last_id=99).select("id", "platform")


# --- statistics --------------------------------------------------------------------------
_STATS = f"""SELECT count(*) AS total, count(*) FILTER (platform = 'youtube') AS youtube,
 count(*) FILTER (platform = 'reddit') AS reddit, count(*) FILTER (platform = 'bluesky') AS bluesky,
 count(*) FILTER (sentiment = 'Positive') AS positive, count(*) FILTER (sentiment = 'Neutral') AS neutral,
 count(*) FILTER (sentiment = 'Negative') AS negative,
 CAST(coalesce(sum({ENGAGEMENT}), 0) AS BIGINT) AS engagement FROM posts WHERE {VISIBLE}"""


def _shown(spark, d):
    return feed.filtered(posts(spark, d), FeedOptions())


@query("a1_dashboard_stats", _STATS)
def _(spark, d):
    return stats.dashboard_stats(_shown(spark, d))


@query("a2_shares", f"""WITH s AS ({_STATS}) SELECT {", ".join(
    f"round(coalesce({n} * 100.0::DOUBLE / nullif(total, 0), 0), 6) AS {n}_pct"
    for n in ("youtube", "reddit", "bluesky", "positive", "neutral", "negative"))} FROM s""")
def _(spark, d):
    out = stats.shares(stats.dashboard_stats(_shown(spark, d)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("a3_top_categories", f"""WITH c AS (SELECT {CATEGORY} AS category,
   row_number() OVER (ORDER BY {FEED_ORDER}) AS r FROM posts WHERE {VISIBLE})
 SELECT category, count(*) AS posts FROM c WHERE category <> '' GROUP BY category
 ORDER BY posts DESC, min(r) LIMIT 5""")
def _(spark, d):
    return stats.top_categories(_shown(spark, d))


_GROUPED = f"""g AS (SELECT *, coalesce(cluster_id, 'single-' || {_TIE}) AS group_key,
   row_number() OVER (ORDER BY {FEED_ORDER}) AS r, {CATEGORY} AS shown_category
   FROM posts WHERE {VISIBLE})"""


@query("a4_cluster_view", f"""WITH {_GROUPED} SELECT id, group_key,
 count(*) OVER (PARTITION BY group_key) AS size,
 first_value(id) OVER (PARTITION BY group_key ORDER BY r) AS first_id FROM g""")
def _(spark, d):
    return stats.cluster_view(_shown(spark, d)).select("id", "group_key", "size", "first_id")


@query("a5_cluster_headers", f"""WITH {_GROUPED} SELECT group_key, count(*) AS size,
 arg_min(coalesce(nullif(summary, ''), nullif(shown_category, ''), 'Related passport conversation'), r)
   AS header FROM g GROUP BY group_key""")
def _(spark, d):
    return stats.cluster_groups(_shown(spark, d)).select("group_key", "size", "header")


@query("a6_cluster_preview", f"""WITH {_GROUPED}, n AS (SELECT group_key, id,
   CAST(row_number() OVER (PARTITION BY group_key ORDER BY r) AS BIGINT) AS position,
   greatest(count(*) OVER (PARTITION BY group_key) - 3, 0) AS more FROM g)
 SELECT group_key, id, position, more FROM n WHERE position <= 3""")
def _(spark, d):
    out = stats.cluster_preview(_shown(spark, d))
    return out.select("group_key", "id", F.col("position").cast("bigint").alias("position"), "more")


# the stored language against the one the region column would suggest: any two columns do
_NEW_LANGUAGE = """CASE WHEN platform = 'reddit' THEN 'eng' WHEN region = 'India' THEN NULL
 ELSE language END"""


def _relabelled(spark, d):
    return posts(spark, d).withColumn("new_language", F.expr(_NEW_LANGUAGE))


@query("a7_language_changes", f"""WITH r AS (SELECT language, {_NEW_LANGUAGE} AS new_language FROM posts)
 SELECT coalesce(language, 'null') || ' -> ' || coalesce(new_language, 'null') AS change,
 count(*) AS posts FROM r WHERE language IS DISTINCT FROM new_language GROUP BY 1""")
def _(spark, d):
    return stats.language_changes(_relabelled(spark, d))


@query("a7_backfill_totals", f"""WITH r AS (SELECT language, {_NEW_LANGUAGE} AS new_language FROM posts)
 SELECT count(*) AS scanned, count(*) FILTER (language IS DISTINCT FROM new_language) AS changed,
 count(*) FILTER (language IS NOT DISTINCT FROM new_language) AS unchanged FROM r""")
def _(spark, d):
    return stats.backfill_totals(_relabelled(spark, d))


@query("a8_ingest_metrics", f"""WITH m AS (SELECT platform AS source,
   coalesce(published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS, false) AS f,
   summary IS NOT NULL AS t FROM posts)
 SELECT source, count(*) AS found, count(*) FILTER (f AND t) AS processed,
 count(*) FILTER (f AND NOT t) AS skipped, count(*) FILTER (f AND t) AS saved FROM m GROUP BY source""")
def _(spark, d):
    start = F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    raw = posts(spark, d).select(
        F.col("platform").alias("source"),
        F.coalesce(F.col("published_at") >= start, F.lit(False)).alias("is_fresh"),
        F.col("summary").isNotNull().alias("has_text"),
    )
    return stats.ingest_metrics(raw)


@query("cl10_cluster_report", f"""SELECT count(*) AS posts, count(DISTINCT cluster_id) AS clusters
 FROM posts WHERE {VISIBLE}""")
def _(spark, d):
    return stats.cluster_report(_shown(spark, d))


# --- writes ------------------------------------------------------------------------------
# The batch holds every post again with one more like and no cached translations; English
# posts are re-deliveries of known keys, all others arrive under a new key.
_BATCH = """b AS (SELECT platform, CASE WHEN language = 'eng' THEN post_id ELSE 'n' || post_id END
   AS post_id, likes + 1 AS likes, original_text FROM posts)"""


def _batch(spark, d):
    key = F.when(F.col("language") == "eng", F.col("post_id")).otherwise(F.concat(F.lit("n"), "post_id"))
    return (
        posts(spark, d)
        .withColumn("post_id", key)
        .withColumn("engagement", F.col("engagement").withField("likes", F.col("engagement.likes") + 1))
        .withColumn("translations", F.create_map().cast("map<string,string>"))
    )


def _now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


@query("k1_upsert", f"""WITH {_BATCH},
 n AS (SELECT platform, post_id, row_number() OVER (ORDER BY platform, post_id) AS place
   FROM b ANTI JOIN posts USING (platform, post_id))
 SELECT coalesce(p.id, (SELECT max(id) FROM posts) + n.place) AS id, coalesce(b.platform, p.platform) AS platform, coalesce(b.post_id, p.post_id) AS post_id,
 p.id AS kept_id, coalesce(b.likes, p.likes) AS likes,
 coalesce(b.original_text, p.original_text) AS original_text,
 CASE WHEN b.post_id IS NULL THEN p.cluster_id END AS cluster_id,
 coalesce(p.created_at, TIMESTAMP '2024-02-01 00:00:00') AS created_at
 FROM posts p FULL OUTER JOIN b ON p.platform = b.platform AND p.post_id = b.post_id
 LEFT JOIN n ON n.platform = b.platform AND n.post_id = b.post_id""")
def _(spark, d):
    out = upsert.upsert_posts(posts(spark, d), _batch(spark, d), _now())
    known = ~F.col("post_id").startswith("n")
    return out.select(
        "id", "platform", "post_id", F.when(known, F.col("id")).alias("kept_id"),
        F.col("engagement.likes").alias("likes"), "original_text", "cluster_id", "created_at",
    )


@query("k2_preserve_translations", f"""WITH {_BATCH}
 SELECT b.platform, b.post_id, p.tr_hindi, p.tr_english
 FROM b LEFT JOIN posts p ON p.platform = b.platform AND p.post_id = b.post_id""")
def _(spark, d):
    out = upsert.preserve_translations(_batch(spark, d), posts(spark, d))
    return out.select(
        "platform", "post_id", F.col("translations")["hindi"].alias("tr_hindi"),
        F.col("translations")["english"].alias("tr_english"),
    )


@query("k3_export_csv", f"""SELECT platform, post_id, creator_name, creator_handle, original_text,
 post_url, published_at, language, region, {CATEGORY} AS category, sentiment,
 CAST({ENGAGEMENT} AS BIGINT) AS total_engagement, summary FROM posts
 WHERE {VISIBLE} AND {ENGAGEMENT} >= 10 AND (contains(lower(original_text), 'passport')
   OR contains(lower(coalesce(summary, '')), 'passport'))""")
def _(spark, d):
    return export.export_table(posts(spark, d), FeedOptions(min_engagement="10", q="passport"))


@query("k4_export_report", f"""WITH r AS (SELECT *, {CATEGORY} AS cat, {ENGAGEMENT} AS eng,
   row_number() OVER (ORDER BY {_EPOCH} DESC, {_TIE}) AS seq FROM posts WHERE {VISIBLE})
 SELECT 0 AS seq, 'Posts report' || chr(10) || 'Posts exported: ' || count(*) AS block FROM r
 UNION ALL SELECT seq, concat_ws(chr(10), seq || '. ' || platform,
   'Creator: ' || coalesce(creator_name, 'Unknown'), 'Category: ' || nullif(cat, ''),
   'Sentiment: ' || sentiment, 'Engagement: ' || eng, coalesce(nullif(original_text, ''), 'No content'),
   'Summary: ' || nullif(summary, ''), 'URL: ' || post_url) FROM r""")
def _(spark, d):
    return export.export_report(posts(spark, d))


@query("k5_apply_clusters", f"""SELECT id,
 CASE WHEN {VISIBLE} THEN 'g-' || platform ELSE cluster_id END AS cluster_id,
 CASE WHEN {VISIBLE} THEN TIMESTAMP '2024-02-01 00:00:00' ELSE created_at END AS updated_at FROM posts""")
def _(spark, d):
    table = posts(spark, d)
    given = feed.visible(table).select("id", F.concat(F.lit("g-"), "platform").alias("cluster_id"))
    return upsert.apply_clusters(table, given, _now()).select("id", "cluster_id", "updated_at")


@query("k7_put_translations", """SELECT id, CASE WHEN summary IS NULL THEN tr_hindi ELSE 'new ' || summary END
 AS tr_hindi, tr_english FROM posts""")
def _(spark, d):
    table = posts(spark, d)
    rows = table.filter(F.col("summary").isNotNull()).select(
        "id", F.lit("Hindi").alias("language"), F.concat(F.lit("new "), "summary").alias("text")
    )
    out = upsert.put_translations(table, rows)
    return out.select(
        "id", F.col("translations")["hindi"].alias("tr_hindi"),
        F.col("translations")["english"].alias("tr_english"),
    )
