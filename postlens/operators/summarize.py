"""Extractive summaries as a Spark job: sentences, token counts, choice, rewriting, guards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import summary as S
from postlens.functions.patterns import java, let, squeeze
from postlens.functions.text import (
    MAX_SUMMARY_WORDS, capitalize, clean_platform_noise, end_sentence, limit_words, word_count,
    words,
)

SCORED = "array<struct<idx:int,sentence:string,tokens:array<string>,words:int,score:double>>"


def placed(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Key and cleaned text."""
    return df.select(*key, clean_platform_noise(F.col(text)).alias("cleaned"))


def repeated_weights(token_lists: Column) -> Column:
    """Per sentence: the sum over its tokens of their count in the text, each at most three.

    Counted in numpy, batch by batch, without a shuffle. The function refers to nothing of
    this package, so workers need not import it.
    """
    rows_at_once = 256

    def weigh(lists: pa.ListArray) -> pa.ListArray:
        n_sentences = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        sentences = lists.flatten()
        n_tokens = pc.list_value_length(sentences).fill_null(0).to_numpy(zero_copy_only=False)
        tokens = sentences.flatten().dictionary_encode(null_encoding="encode")
        of_row = np.repeat(np.repeat(np.arange(len(lists)), n_sentences), n_tokens)
        named = of_row * max(1, len(tokens.dictionary)) + tokens.indices.to_numpy(zero_copy_only=False)
        _, which, times = np.unique(named, return_inverse=True, return_counts=True)
        total = np.concatenate([[0], np.cumsum(np.minimum(times, 3)[which])])
        ends = np.cumsum(n_tokens)
        first = np.concatenate([[0], np.cumsum(n_sentences)]).astype(np.int32)
        sums = pa.array(total[ends] - total[ends - n_tokens], pa.int64())
        return pa.ListArray.from_arrays(pa.array(first), sums, mask=lists.is_null())

    @F.arrow_udf("array<bigint>")
    def sums(lists: pa.Array) -> pa.Array:
        parts = [weigh(lists.slice(a, rows_at_once)) for a in range(0, len(lists), rows_at_once)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    # declared so that later lambdas use its column instead of a second call
    return sums.asNondeterministic()(token_lists)


def with_scores(df: DataFrame) -> DataFrame:
    """Add ``scored``: every sentence of ``cleaned``, a squeezed text, with its tokens, words
    and score.

    All of it is a function of one row; nothing is shuffled.
    """
    cut = F.transform(
        S.split_sentences(F.col("cleaned")),
        lambda s: let(
            S.squeezed_tokens(s),
            lambda t: F.struct(s.alias("sentence"), t.alias("tokens"), F.array_distinct(t).alias("different")),
        ),
    )

    def entry(part: Column, i: Column, repeated: Column) -> Column:
        sentence, tokens = part["sentence"], part["tokens"]
        return F.struct(
            i.cast("int").alias("idx"), sentence.alias("sentence"),
            part["different"].alias("tokens"), F.size(words(sentence)).alias("words"),
            S.sentence_weight(sentence, i, F.get(repeated, i), tokens, part["different"]).alias("score"),
        )

    # bound outside the lambda: a column named inside it once would be inlined there and
    # computed again for every sentence
    scored = let(
        F.struct(F.col("_parts").alias("parts"), F.col("_repeated").alias("repeated")),
        lambda p: F.transform(p["parts"], lambda part, i: entry(part, i, p["repeated"])),
    )
    return (
        df.withColumn("_parts", cut).withColumn("_repeated", repeated_weights(F.col("_parts.tokens")))
        .withColumn("scored", scored.cast(SCORED)).drop("_parts", "_repeated")
    )


def score_sentences(base: DataFrame, key: list[str]) -> DataFrame:
    """``(key, cleaned, scored)`` from ``(key, cleaned)``."""
    return with_scores(base.select(*key, "cleaned"))


def core_sentences(
    df: DataFrame, key: list[str], text: str, budget: int = S.TARGET_WORDS, at_most: int = 2
) -> DataFrame:
    """``(key, core)``: the chosen sentences of every post, in their own order."""
    scored = score_sentences(placed(df, key, text), key)
    return scored.select(*key, S.pick_sentences(F.col("scored"), budget, at_most).alias("core"))


def with_compressed(df: DataFrame) -> DataFrame:
    """Add ``compressed``, ``condensed`` and ``promotional``: compressor's text, model's
    shortened input, and whether the text advertises.

    The input of a long text is its chosen sentences; where they yield too little it is the
    whole cleaned text, never a prefix of it.
    """
    wide = F.length("cleaned") > S.MODEL_INPUT_CHARS
    condensed = F.when(
        wide, F.array_join(S.pick_sentences(F.col("scored"), 320, 10), " ")
    )
    enough = F.coalesce(F.length("_condensed") >= 40, F.lit(False))
    return (
        with_scores(df)
        .withColumns(
            {
                "_core": S.pick_sentences(F.col("scored"), S.TARGET_WORDS, 2), "_condensed": condensed,
                "promotional": S.squeezed_promotional(F.col("cleaned")),
            }
        )
        .withColumns(
            {
                "compressed": S.compress(
                    F.col("cleaned"), F.col("_core"), F.col("promotional")
                ),
                "condensed": F.when(enough, F.col("_condensed")).otherwise(F.col("cleaned")),
            }
        )
        .drop("scored", "_core", "_condensed")
    )


def compress(df: DataFrame, key: list[str], text: str = "original_text") -> DataFrame:
    """``(key, compressed)`` for every post; null where cleaning leaves nothing."""
    return with_compressed(placed(df, key, text)).select(*key, "compressed")


def model_input(df: DataFrame, key: list[str], text: str = "original_text") -> DataFrame:
    """``(key, condensed)``: what a summary model should read."""
    return with_compressed(placed(df, key, text)).select(*key, "condensed")


def summary_guards(pairs: DataFrame, source: str = "source", summary: str = "summary") -> DataFrame:
    """Add one flag per guard and ``rejected`` over ``(source, summary)`` pairs."""
    src, out = F.col(source), F.col(summary)
    flags = {
        "degenerate": S.degenerate(out),
        "copied": S.copied_phrase(src, out),
        "verbatim": S.verbatim_prefix(src, out),
        "unfaithful": S.unfaithful(src, out),
        "too_few_words": S.lost_words(src, out),
        "lost_question": S.lost_question(src, out),
    }
    flagged = pairs.withColumns(flags)
    rejected = F.greatest(*[F.col(f).cast("int") for f in flags]) > 0
    return flagged.withColumn("rejected", rejected)


def summarize(
    df: DataFrame, key: list[str], text: str = "original_text", candidates: DataFrame | None = None
) -> DataFrame:
    """``(key, summary, method)`` for every row.

    ``candidates(key, candidate)`` are texts any model made from ``model_input``; without
    one a long post falls back to the compressor.
    """
    base = df.select(*key, F.col(text).alias("_text"))
    if candidates is None:
        return with_summary(base, F.col("_text")).select(*key, "summary", "method")
    offered = base.join(candidates.select(*key, F.col("candidate").alias("_offer")), key, "left")
    return with_summary(offered, F.col("_text"), F.col("_offer")).select(*key, "summary", "method")


def with_summary(df: DataFrame, text: Column, offer: Column | None = None) -> DataFrame:
    """Add ``summary`` and ``method`` to ``df``, row by row.

    The other columns travel in one struct, so their names cannot clash with those used here.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    given = F.lit(None).cast("string") if offer is None else S.tidy_candidate(offer)
    base = with_compressed(
        df.select(
            carried, squeeze(text).alias("full"), clean_platform_noise(text).alias("cleaned"),
            given.alias("candidate"),
        )
    )
    full, cleaned, candidate = F.col("full"), F.col("cleaned"), F.col("candidate")
    staged = base.select(
        "_row", "full", "cleaned", "compressed", "candidate", "promotional",
        F.size(words(full)).alias("n_words"),
        # only a text that mentions the marker can hold the author's short version
        F.when(full.rlike(java(S.TLDR)), S.author_tldr(full)).alias("tldr"),
        S.squeezed_question(full).alias("question"),
    )
    has_candidate, failed = F.lit(False), F.lit(False)
    if offer is not None:
        has_candidate = F.coalesce(candidate, F.lit("")) != ""
        failed = (
            S.degenerate(candidate) | S.copied_phrase(cleaned, candidate)
            | S.verbatim_prefix(cleaned, candidate) | S.unfaithful(cleaned, candidate)
            | ((word_count(candidate) < S.MIN_SUMMARY_WORDS) & (F.col("n_words") > 18))
            | (F.col("question") & ~F.contains(candidate, F.lit("?")))
        )
    method = (
        F.when(full == "", "none")
        .when(F.col("tldr").isNotNull(), "author_tldr")
        .when(F.col("n_words") <= S.TINY_POST_WORDS, "tiny_post_label")
        .when(cleaned == "", "cleaned_empty")
        .when(F.col("n_words") < S.SHORT_POST_WORDS, "compressor_short_post")
        .when(F.col("question") | F.col("promotional"), "compressor_type_routed")
        .when(~has_candidate, "compressor_model_empty")
        .when(failed, "compressor_quality_guard")
        .otherwise("model")
    )
    finish = lambda t: end_sentence(capitalize(t))
    summary = (
        F.when(F.col("method") == "none", F.lit(None).cast("string"))
        .when(F.col("method") == "author_tldr", finish(limit_words(F.col("tldr"), MAX_SUMMARY_WORDS)))
        .when(F.col("method") == "tiny_post_label", F.coalesce(S.tiny_label(full, cleaned), limit_words(full)))
        .when(F.col("method") == "cleaned_empty", limit_words(full))
        .when(F.col("method") == "model", finish(F.col("candidate")))
        .otherwise(F.coalesce("compressed", limit_words(cleaned)))
    )
    return staged.withColumn("method", method).select("_row.*", summary.alias("summary"), "method")
