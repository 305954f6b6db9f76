"""Sentiment against a lexicon kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.labels import sentiment_label, sentiment_tokens
from postlens.functions.rules import LEXICON, NEGATORS


def default_lexicon(spark) -> DataFrame:
    rows = [(w, s) for s, listed in LEXICON.items() for w in listed.split()]
    return spark.createDataFrame(rows, "word string, score int")


def sentiment_by_lexicon(
    df: DataFrame, lexicon: DataFrame, key: list[str], text: str = "original_text"
) -> DataFrame:
    """``(key, score, sentiment)`` for every row, words scored by a join.

    For a lexicon too large to be written into an expression (see ``functions.labels``). The
    engine broadcasts it while its size is below the session's threshold.
    Texts are reduced to their matched words before anything is grouped.
    """
    known = lexicon.groupBy("word").agg(F.sum("score").alias("score"))
    tokens = df.select(*key, sentiment_tokens(F.col(text)).alias("_tokens"))
    shifted = F.concat(F.array(F.lit("")), F.col("_tokens"))
    pairs = tokens.select(*key, F.explode_outer(F.arrays_zip(F.col("_tokens").alias("word"), shifted.alias("prev"))).alias("p"))
    words = pairs.select(*key, "p.word", F.col("p.prev").isin(NEGATORS).alias("negated"))
    signed = F.when(F.col("negated"), -F.col("score")).otherwise(F.col("score"))
    summed = words.join(known, "word", "left").groupBy(*key).agg(
        F.coalesce(F.sum(signed), F.lit(0)).cast("bigint").alias("score")
    )
    return summed.withColumn("sentiment", sentiment_label(F.col("score")))
