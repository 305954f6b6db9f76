import datetime as dt

import pytest
from pyspark.sql import functions as F

from postlens.functions.posts import total_engagement
from postlens.operators import export, feed, upsert
from postlens.operators.feed import FeedOptions, like_pattern, parse_number
from postlens.plans.fixture import posts

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parse_number():
    cases = {"": 0, " 12 ": 12, "1e3": 1000, "0x10": 16, "abc": None, "-.5": -0.5, None: None, "1,5": None, "+3.": 3}
    assert {k: parse_number(k) for k in cases} == cases


def test_like_pattern():
    assert like_pattern(r"a\bc") == "%abc%"
    assert like_pattern(r"a\%b_") == r"%a\%b_%"


def test_blank_search_is_an_error(spark):
    with pytest.raises(ValueError):
        feed.search(posts(spark, SF), "   ")


def test_time_predicates_need_a_clock(spark):
    with pytest.raises(ValueError):
        feed.filtered(posts(spark, SF), FeedOptions(last_24h=True))


def test_engagement_cases(spark):
    rows = [
        ("youtube", 1, 2, 3, 4, 5), ("reddit", 1, 2, 3, 4, None), ("reddit", 1, 2, 3, 4, 0),
        ("bluesky", 1, 2, 3, 4, 5), ("other", 1, 2, 3, 4, 5), ("YouTube", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "platform string, views long, likes long, comments long, reposts long, score long")
    nested = df.withColumn("engagement", F.struct("views", "likes", "comments", "reposts", "score"))
    assert [r[0] for r in nested.select(total_engagement()).collect()] == [6, 5, 3, 9, 0, 0]


def ordering(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(9, t(2), 5), (10, t(2), 5), (1, None, 7), (2, t(3), 0)]
    return spark.createDataFrame(rows, "id long, published_at timestamp_ntz, total_engagement long").withColumn(
        "post_id", F.lit("p")
    )


def ids(df, order):
    return [r.id for r in df.orderBy(*order).collect()]


def test_orderings_differ_on_missing_times_and_ties(spark):
    df = ordering(spark)
    assert ids(df, feed.feed_order(FeedOptions())) == [1, 2, 9, 10]
    assert ids(df, feed.feed_order(FeedOptions(order="ASC"))) == [9, 10, 2, 1]
    # a missing time is the epoch, ties go by the identity as text in both directions
    assert ids(df, feed.export_order()) == [2, 10, 9, 1]
    assert ids(df, feed.export_order(order="asc")) == [1, 10, 9, 2]
    assert ids(df, feed.dashboard_order("engagement-desc")) == [1, 10, 9, 2]
    assert [r.seq for r in export.numbered(df, feed.export_order()).orderBy("seq").collect()] == [1, 2, 3, 4]


def test_unknown_sort_falls_back(spark):
    assert FeedOptions(sort="nonsense").sort_field == "published_at"


def test_upsert_twice_changes_nothing(spark):
    target = posts(spark, SF)
    batch = target.filter(F.col("language") == "eng").withColumn("sentiment", F.lit("Negative"))
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    once = upsert.upsert_posts(target, batch, now)
    twice = upsert.upsert_posts(once, batch, now)
    pick = lambda df: sorted(df.select("id", "post_id", "sentiment", "cluster_id", "created_at").collect(), key=str)
    assert pick(once) == pick(twice)
    assert once.count() == target.count()


def test_upsert_keeps_the_last_of_a_repeated_key(spark):
    target = posts(spark, SF)
    batch = target.limit(1).select(*target.columns)
    later = batch.withColumn("published_at", F.lit("2030-01-01").cast("timestamp_ntz")).withColumn(
        "sentiment", F.lit("late")
    )
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    out = upsert.upsert_posts(target, batch.unionByName(later), now)
    assert out.filter("sentiment = 'late'").count() == 1
    assert out.count() == target.count()


def test_new_rows_get_fresh_ids(spark):
    target = posts(spark, SF)
    batch = target.withColumn("post_id", F.concat(F.lit("new"), "post_id"))
    out = upsert.upsert_posts(target, batch, F.lit("2024-02-01").cast("timestamp_ntz"))
    assert out.select("id").distinct().count() == 2 * target.count()


def test_csv_round_trip(spark, tmp_path):
    export.export_csv(posts(spark, SF), str(tmp_path / "out"), FeedOptions(platform="reddit"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "out"))
    assert back.columns == export.EXPORT_FIELDS
    assert back.count() == feed.filtered(posts(spark, SF), FeedOptions(platform="reddit")).count()


def test_filters_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = str(tmp_path / "posts")
    posts(spark, SF).write.partitionBy("platform").parquet(path)
    table = spark.read.parquet(path)
    options = FeedOptions(platform="youtube", language="eng", sentiment="Positive", time_from="2024-01-01")
    text = plan(feed.feed(table, options).select("id", "published_at"))
    assert "EqualTo(language,eng)" in text and "GreaterThanOrEqual(published_at" in text
    assert "PartitionFilters: [isnotnull(platform" in text
    scan = text[text.index("ReadSchema"):]
    assert "original_text" not in scan and "raw_data" not in scan
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_group_limit_runs_before_the_shuffle(spark):
    from postlens.operators.stats import cluster_preview

    text = plan(cluster_preview(posts(spark, SF)))
    assert text.count("WindowGroupLimit") == 2


def test_ids_stay_dense_over_many_merges(spark):
    table = posts(spark, SF).limit(20)
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    start, top = table.count(), table.agg(F.max("id")).first()[0]
    for k in range(5):
        fresh = table.limit(7).withColumn("post_id", F.concat(F.lit(f"m{k}-"), "post_id"))
        table = upsert.upsert_posts(table, fresh.unionByName(fresh).repartition(4), now).checkpoint()
    assert table.count() == start + 35
    assert sorted(r.id for r in table.filter("post_id LIKE 'm%'").select("id").collect()) == list(range(top + 1, top + 36))
