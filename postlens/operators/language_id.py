"""Statistical language identification by trigram rank distance.

Profiles are trained by grouping; a text is then ranked inside its row, against a model of
bounded size, so that no text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.functions.language import (
    MIN_REFINE_LENGTH, dominant_script, mostly_not_latin, settle_latin,
)
from postlens.functions.patterns import java, let, utf16_length
from postlens.functions.text import (
    TAG_OR_MENTION_ANY_SCRIPT, URL, strip_html, strip_language_noise, strip_urls,
)

PROFILE_SIZE = 300
MIN_RANKED_LENGTH = 10
MAX_LANGUAGES = 1000
MIN_IDENTIFY_LENGTH = 20


def letters_only(text: Column) -> Column:
    """Lower-cased words made of letters and marks, parted by one blank."""
    # letters of ASCII leave the class at its first tests
    other = r"[\x{0}-`\x{7B}-\x{10FFFF}&&[^\p{L}\p{M}]]+"
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), other, " ")


def letter_words(text: Column) -> Column:
    """The words of ``letters_only``."""
    return F.filter(F.split(letters_only(text), " "), lambda w: w != "")


def word_trigrams(word: Column) -> Column:
    """Character trigrams of a word with one blank on either side."""
    return let(
        F.split(F.concat(F.lit(" "), word, F.lit(" ")), ""),
        lambda chars: F.transform(
            F.slice(chars, F.lit(1), F.size(chars) - 2),
            lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)),
        ),
    )


def _profile(words: DataFrame, group: list[str]) -> DataFrame:
    """``(group, tri, rank)``: the most frequent trigrams, rank 0 first, ties by the trigram.

    Equal words are counted before they are cut into trigrams. The rank limit also runs
    before any shuffle, so a group never sends more rows per task than a profile holds.
    """
    counted = words.groupBy(*group, "word").agg(F.count(F.lit(1)).alias("_n"))
    cut = counted.select(*group, "_n", F.explode(word_trigrams(F.col("word"))).alias("tri"))
    totals = cut.groupBy(*group, "tri").agg(F.sum("_n").alias("_n"))
    best_first = Window.partitionBy(*group).orderBy(F.desc("_n"), F.asc("tri"))
    ranked = totals.withColumn("rank", F.row_number().over(best_first))
    return ranked.filter(F.col("rank") <= PROFILE_SIZE).select(
        *group, "tri", (F.col("rank") - 1).alias("rank")
    )


def train_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, tri, rank)``: the 300 most frequent trigrams of every language."""
    words = labelled.select(F.col(lang).alias("lang"), F.explode(letter_words(F.col(text))).alias("word"))
    return _profile(words, ["lang"])


def _places(profiles: DataFrame) -> list[tuple[str, str, int]]:
    """``(tri, lang, rank)``; bounded by 300 rows for each allowed language."""
    limit = MAX_LANGUAGES * PROFILE_SIZE
    rows = profiles.select("tri", "lang", "rank").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"profiles of more than {MAX_LANGUAGES} languages")
    return [tuple(r) for r in rows if len(r[0]) == 3]


def _ranking(profiles: DataFrame):
    """Function of a text column: ``array<struct<distance, lang>>``, nearest first, of every
    language sharing a trigram with the text.

    The out-of-place distance is what all trigrams of the text would cost when missing, less
    what the shared ones save. Counted in numpy, about a megabyte of text at a time. The
    function refers to nothing of this package, so workers need not import it.
    """
    # languages in their order, null last; trigrams as numbers of 63 bits, in order
    places = _places(profiles)
    langs = sorted({lang for _, lang, _ in places}, key=lambda x: (x is None, x or ""))
    number = {lang: i for i, lang in enumerate(langs)}
    rows = sorted((sum(ord(c) << 21 * (2 - i) for i, c in enumerate(t)), number[lang], rank) for t, lang, rank in places)
    shared = profiles.sparkSession.sparkContext.broadcast((langs, np.array(rows, np.int64).reshape(-1, 3)))
    size, chars_at_once = PROFILE_SIZE, 1 << 20

    def distances(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, distance and number of the language of every hit, in order."""
        langs, model = shared.value
        line = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(int(line.max()) + 1, bool)
        seen[line] = True
        chars = np.flatnonzero(seen)
        base = len(chars)
        if len(texts) > 1 and len(texts) * base**3 >= 1 << 63:
            half = len(texts) // 2
            left, right = distances(texts[:half]), distances(texts[half:])
            return tuple(np.concatenate(x) for x in zip(left, (right[0] + half, *right[1:])))
        # every letter is the middle of one trigram; a blank parts words and texts
        dense = (np.cumsum(seen) - 1)[line]
        at = np.flatnonzero(line != 32)
        of_row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[at - 1]
        keys = np.sort(((of_row * base + dense[at - 1]) * base + dense[at]) * base + dense[at + 1])
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, times = keys[first], np.diff(first, append=len(keys))
        # by falling count, ties by the trigram, which the keys are in order of
        row, tri = np.divmod(keys, base**3)
        most = int(times.max(initial=0)) + 1
        order = np.argsort(row * most + (most - 1 - times), kind="stable")
        starts = np.searchsorted(row, np.arange(len(texts)))
        rank = np.arange(len(row)) - starts[row]
        kept = np.flatnonzero(rank < size)
        row, rank, tri = row[kept], rank[kept], tri[order[kept]]
        n_own = np.bincount(row, minlength=len(texts))
        points = chars[tri // base**2] << 42 | chars[tri // base % base] << 21 | chars[tri % base]
        low, high = (np.searchsorted(model[:, 0], points, side) for side in ("left", "right"))
        hits = high - low
        which = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
        pair = np.repeat(row, hits) * len(langs) + model[which, 1]
        gain = size - np.abs(np.repeat(rank, hits) - model[which, 2])
        found = np.flatnonzero(np.bincount(pair))
        saved = np.bincount(pair, gain)[found].astype(np.int64)
        row, lang = np.divmod(found, max(1, len(langs)))
        distance = n_own[row] * size - saved
        nearest = np.lexsort((lang, distance, row))
        return row[nearest], distance[nearest], lang[nearest]

    def ranked(letters: pa.Array) -> pa.Array:
        texts = letters.fill_null("").to_pylist()
        row, distance, lang = distances(texts) if texts else (np.zeros(0, np.int64),) * 3
        ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
        named = pa.array(shared.value[0], pa.string()).take(pa.array(lang))
        pairs = pa.StructArray.from_arrays([pa.array(distance), named], names=["distance", "lang"])
        return pa.ListArray.from_arrays(pa.array(ends), pairs)

    def runs(letters: pa.Array) -> list[pa.Array]:
        """Slices of about ``chars_at_once`` bytes."""
        ends = np.cumsum(pc.binary_length(letters).fill_null(0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // chars_at_once, prepend=0))
        edges = np.unique([0, *cuts, len(letters)])
        return [letters.slice(a, b - a) for a, b in zip(edges[:-1], edges[1:])]

    @F.arrow_udf("array<struct<distance:bigint,lang:string>>")
    def nearest_first(letters: pa.Array) -> pa.Array:
        return pa.concat_arrays([ranked(part) for part in runs(letters)] or [ranked(letters)])

    # declared so that later filters and lambdas use its column instead of a second call
    once = nearest_first.asNondeterministic()
    return lambda text: once(letters_only(text))


def rank_languages(df: DataFrame, profiles: DataFrame, key: list[str], text: Column) -> DataFrame:
    """``(key, lang, distance, place)`` for texts of at least ten characters, nearest first."""
    usable = F.when(utf16_length(text) >= MIN_RANKED_LENGTH, text)
    found = df.select(*key, _ranking(profiles)(usable).alias("_found"))
    return found.select(*key, F.posexplode("_found").alias("_at", "_hit")).select(
        *key, "_hit.lang", "_hit.distance", (F.col("_at") + 1).alias("place")
    )


def identify(df: DataFrame, profiles: DataFrame, key: list[str], text: Column) -> DataFrame:
    """``(key, lang)``: the nearest language; texts without any shared trigram have no row."""
    ranked = rank_languages(df, profiles, key, text)
    return ranked.filter(F.col("place") == 1).select(*key, "lang")


def with_language(df: DataFrame, profiles: DataFrame, text: str = "original_text") -> DataFrame:
    """Add ``new_language`` and ``identified``, which is null when it was not tried.

    Script first; else identification on texts of at least 20 characters, settled for Latin
    text by a second identification on the text without noise. Only texts without a
    dominant script reach the statistics, and only those with links, tags or mentions count
    twice: for the rest both identifications see the same letters.
    """
    rank = _ranking(profiles)
    nearest = lambda name: F.get(F.col(name), F.lit(0))["lang"]
    plain, cleaned = F.col("_plain"), F.col("_cleaned")
    asked = F.col("_script").isNull() & (utf16_length(plain) >= MIN_IDENTIFY_LENGTH)
    held = F.contains(plain, F.lit("://")) | F.contains(plain, F.lit("#")) | F.contains(plain, F.lit("@"))
    noisy = held & plain.rlike(java(f"{URL}|{TAG_OR_MENTION_ANY_SCRIPT}"))
    staged = (
        df.withColumn("_plain", strip_urls(strip_html(F.col(text))))
        .withColumn("_script", dominant_script(plain))
        .withColumns({"_asked": asked, "_noisy": noisy})
        .withColumn("_cleaned", F.when(F.col("_asked"), strip_language_noise(plain)))
        .withColumns(
            {
                "_first": rank(F.when(F.col("_asked"), plain)),
                "_second": rank(F.when(F.col("_noisy"), cleaned)),
            }
        )
        .withColumns({"_first": nearest("_first"), "_second": nearest("_second")})
    )
    opinion = F.when(F.col("_noisy"), F.col("_second")).otherwise(F.col("_first"))
    settled = settle_latin(
        mostly_not_latin(cleaned), utf16_length(cleaned) >= MIN_REFINE_LENGTH, F.col("_first"), opinion
    )
    return staged.withColumns(
        {
            "new_language": F.coalesce("_script", F.when(F.col("_first").isNotNull(), settled)),
            "identified": F.when(F.col("_asked"), F.col("_first").isNotNull()),
        }
    ).drop("_plain", "_script", "_asked", "_noisy", "_cleaned", "_first", "_second")


def decide_language(
    df: DataFrame, profiles: DataFrame, key: list[str], text: str = "original_text"
) -> DataFrame:
    """``(key, new_language, identified)`` as ``with_language`` decides them."""
    texts = df.select(*key, F.col(text).alias("_text"))
    return with_language(texts, profiles, "_text").select(*key, "new_language", "identified")
