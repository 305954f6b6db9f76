"""The posts view over the given documents table, in Spark and in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-02 12:00:00"

_SELECT = """SELECT doc_id AS id,
 CASE doc_id % 3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'reddit' ELSE 'bluesky' END AS platform,
 'p' || CAST(doc_id AS string) AS post_id,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'Creator ' || source END AS creator_name,
 CASE doc_id % 3 WHEN 0 THEN 'UC' || source WHEN 1 THEN 'u/' || source
   ELSE source || '.bsky.social' END AS creator_handle,
 (CASE doc_id % 12
   WHEN 0 THEN 'Passport appointment slot in New Delhi was cancelled. '
   WHEN 1 THEN 'My passport renewal took three weeks in London. '
   WHEN 2 THEN 'Tatkal passport is great and easy in Mumbai! '
   WHEN 3 THEN 'Warning about a passport scam near Toronto. '
   WHEN 4 THEN 'Visa application with an Indian passport? '
   WHEN 5 THEN 'New passport documents needed for Sydney. '
   WHEN 6 THEN 'Passport and border trouble: stopped in Dubai. '
   WHEN 7 THEN 'Government changed the passport rules in Paris. '
   WHEN 8 THEN 'Passport holder leather wallet, 50% off, now only $20. '
   WHEN 9 THEN 'My passport is full of stamps. '
   WHEN 10 THEN 'Immigration news without the document. '
   ELSE '' END) || text AS original_text,
 CASE WHEN doc_id % 11 = 0 THEN NULL
   ELSE 'https://example.org/p/' || CAST(doc_id AS string) END AS post_url,
 CASE WHEN doc_id % 97 = 0 THEN NULL ELSE
   {TS} '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (doc_id * 7 % 43200) END AS published_at,
 {TS} '2024-01-02 00:00:00' + INTERVAL '1' MINUTE * doc_id AS created_at,
 CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra'
   WHEN 'es' THEN 'spa' END AS language,
 CASE doc_id % 6 WHEN 0 THEN 'India' WHEN 1 THEN 'UnitedKingdom' WHEN 2 THEN 'UnitedStates'
   WHEN 3 THEN 'Canada' WHEN 4 THEN 'NewZealand' ELSE NULL END AS region,
 CASE doc_id % 12 WHEN 0 THEN 'Appointments' WHEN 1 THEN 'Renewal' WHEN 2 THEN 'Tatkal'
   WHEN 3 THEN '{{"category":"Scams/Fraud"}}' WHEN 4 THEN 'Visa' WHEN 5 THEN 'Application'
   WHEN 6 THEN 'Travel Issues' WHEN 7 THEN '"Government Announcements"'
   WHEN 9 THEN 'Personal Experiences' ELSE NULL END AS category,
 CASE doc_id % 5 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' ELSE 'Neutral' END AS sentiment,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE substr(text, 1, 80) END AS summary,
 (doc_id % 13 = 0) AS is_gibberish,
 (doc_id % 12 NOT IN (8, 10, 11)) AS is_relevant,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'c' || CAST(doc_id % 40 AS string) END AS cluster_id,
 (doc_id * 37) % 5000 AS views, (doc_id * 11) % 700 AS likes, (doc_id * 5) % 90 AS comments,
 (doc_id * 3) % 40 AS reposts,
 CASE WHEN doc_id % 2 = 0 THEN (doc_id * 13) % 300 END AS score,
 CASE WHEN doc_id % 8 = 1 THEN 'hi ' || substr(text, 1, 20) END AS tr_hindi,
 CASE WHEN doc_id % 9 = 2 THEN 'en ' || substr(text, 1, 20) END AS tr_english
FROM {documents}"""


def posts_sql(documents: str = "documents") -> str:
    """The flat posts view for the SQL checks."""
    return _SELECT.format(TS="TIMESTAMP", documents=documents)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the splits of its files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _SELECT.replace("{TS}", "TIMESTAMP_NTZ")
    return spark.sql(query, documents=read(spark, sf_dir, "documents"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts table: engagement struct, translations map, no raw payload."""
    return nest(posts_flat(spark, sf_dir))


def nest(flat: DataFrame) -> DataFrame:
    counters = ["views", "likes", "comments", "reposts", "score"]
    cached = F.create_map(F.lit("hindi"), F.col("tr_hindi"), F.lit("english"), F.col("tr_english"))
    return (
        flat.withColumn("engagement", F.struct(*counters))
        .withColumn("translations", F.map_filter(cached, lambda _, v: v.isNotNull()))
        .withColumn("updated_at", F.col("created_at"))
        .drop(*counters, "tr_hindi", "tr_english")
    )
