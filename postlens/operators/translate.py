"""Translation as table work: routing, cache lookup, chunking and applying a translator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postlens.functions.patterns import JAVA_WS_CHARS, WS_RUN, java, let, present, trim_ws, utf16_length

# --- fixed values: targets, languages with a direct model, aliases -------------------------
TARGETS = {
    "english": ("eng", "en"), "hindi": ("hin", "hi"), "spanish": ("spa", "es"),
    "french": ("fra", "fr"), "german": ("deu", "de"), "arabic": ("arb", "ar"),
    "chinese": ("cmn", "zh"), "russian": ("rus", "ru"), "japanese": ("jpn", "jap"),
    "vietnamese": ("vie", "vi"), "indonesian": ("ind", "id"), "punjabi": ("pan", "pa"),
}
MODELS = {
    "eng": "en", "hin": "hi", "spa": "es", "fra": "fr", "deu": "de", "arb": "ar", "ara": "ar",
    "cmn": "zh", "zho": "zh", "rus": "ru", "jpn": "jap", "vie": "vi", "ind": "id", "pan": "pa",
}
REMOTE_CODES = {
    "eng": "en", "hin": "hi", "spa": "es", "fra": "fr", "deu": "de", "arb": "ar", "ara": "ar",
    "cmn": "zh-CN", "zho": "zh-CN", "rus": "ru", "jpn": "ja", "vie": "vi", "ind": "id", "pan": "pa",
}
ALIASES = {
    "english": "eng", "en": "eng", "hindi": "hin", "hi": "hin", "spanish": "spa", "es": "spa",
    "french": "fra", "fr": "fra", "german": "deu", "de": "deu", "arabic": "arb", "ara": "arb",
    "ar": "arb", "chinese": "cmn", "zho": "cmn", "zh": "cmn", "russian": "rus", "ru": "rus",
    "japanese": "jpn", "ja": "jpn", "vietnamese": "vie", "vi": "vie", "indonesian": "ind",
    "id": "ind", "punjabi": "pan", "pa": "pan", "sco": "eng", "und": None, "unknown": None,
}
MAX_CHARS = 512
CHUNK_BYTES = 450
TOKEN_GAP = f"[{JAVA_WS_CHARS}]+"
#: Bytes of text that a worker holds as Python objects at once, one row at least.
WORKER_BYTES = 1 << 20
# ---------------------------------------------------------------------------------------


def _lookup(table: dict, key: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in table.items() if v is not None for x in (k, v)])
    return F.element_at(known, key)


def targets(spark: SparkSession) -> DataFrame:
    """The supported target languages."""
    rows = [(name, code, suffix) for name, (code, suffix) in TARGETS.items()]
    return spark.createDataFrame(rows, "target string, code string, suffix string")


def normalize_source(language: Column) -> Column:
    """Code of a language with a direct model: names, two-letter codes and aliases; else null."""
    value = F.lower(trim_ws(language))
    return F.when(value.isin(list(ALIASES)), _lookup(ALIASES, value)).when(
        value.isin(list(MODELS)), value
    )


def raw_source(language: Column) -> Column:
    """Any plausible code, for the many-to-English model: alias first, else 2-3 letters."""
    value = F.lower(trim_ws(language))
    return F.when(value.isin(list(ALIASES)), _lookup(ALIASES, value)).when(
        value.rlike("^[a-z]{2,3}$"), value
    )


def _in_codes(df: DataFrame, code: Column, many_to_english: DataFrame, name: str) -> DataFrame:
    """Add the flag ``name``: the many-to-English model reads ``code``.

    A join with the distinct codes, however many there are; the engine picks its kind.
    """
    codes = many_to_english.select(F.col("code").alias("_code")).filter("_code IS NOT NULL").distinct()
    marked = codes.withColumn(name, F.lit(True))
    return df.join(marked, code == F.col("_code"), "left").drop("_code").withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def first_supported(ranked: DataFrame, key: list[str], many_to_english: DataFrame) -> DataFrame:
    """``(key, detected, detected_via_many)``: the best ranked language anything can translate."""
    known = _in_codes(ranked, F.col("lang"), many_to_english, "_many")
    usable = known.withColumn("_direct", normalize_source(F.col("lang"))).filter(
        F.col("_direct").isNotNull() | F.col("_many")
    )
    best = F.min_by(F.struct("_direct", "lang"), "place").alias("b")
    return usable.groupBy(*key).agg(best).select(
        *key, F.coalesce("b._direct", "b.lang").alias("detected"),
        F.col("b._direct").isNull().alias("detected_via_many"),
    )


def with_source(
    requests: DataFrame, many_to_english: DataFrame, detected: DataFrame | None = None,
    key: list[str] = ["id"],
) -> DataFrame:
    """Add ``source_code`` and ``via_many``: stated language, else code, else detection."""
    direct = normalize_source(F.col("source_language"))
    raw = raw_source(F.col("source_language"))
    requests = _in_codes(requests, raw, many_to_english, "_many")
    coded = F.when(F.col("_many"), raw)
    if detected is None:
        out = requests.withColumn("detected", F.lit(None).cast("string")).withColumn(
            "detected_via_many", F.lit(None).cast("boolean")
        )
    else:
        out = requests.join(detected, key, "left")
    return out.withColumn("source_code", F.coalesce(direct, coded, F.col("detected"))).withColumn(
        "via_many",
        F.when(direct.isNotNull(), False).when(coded.isNotNull(), True).otherwise(F.col("detected_via_many")),
    ).drop("detected", "detected_via_many", "_many")


def cached_translation(translations: Column, target: Column) -> Column:
    """The stored translation when it is not blank."""
    stored = F.element_at(translations, F.lower(target))
    return F.when(trim_ws(stored) != "", stored)


def truncate(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """``struct<text, truncated_at>``: the first characters, and the limit if it applied."""
    return F.struct(
        F.substring(text, 1, max_chars).alias("text"),
        F.when(utf16_length(text) > max_chars, max_chars).alias("truncated_at"),
    )


def translation_plan(
    requests: DataFrame, mode: str = "local", max_chars: int | None = None
) -> DataFrame:
    """Add ``method`` or ``error``, ``truncated_at`` and the codes a translator needs.

    Expects ``text, target_language, translations, source_code, via_many``. The order is
    cache, validity, same language, then the mode's routes. Whole texts are translated;
    ``max_chars`` cuts them (``MAX_CHARS`` is the fixed value) and says so in
    ``truncated_at``, which is null otherwise.
    """
    limit = F.lit(None).cast("int") if max_chars is None else truncate(F.col("text"), max_chars)["truncated_at"]
    text, target = F.col("text"), F.lower(trim_ws(F.col("target_language")))
    staged = requests.withColumns(
        {
            "cached": cached_translation(F.col("translations"), F.col("target_language")),
            "target_suffix": _lookup({k: v[1] for k, v in TARGETS.items()}, target),
            "target_code": _lookup({k: v[0] for k, v in TARGETS.items()}, target),
            "source_suffix": F.when(~F.col("via_many"), _lookup(MODELS, F.col("source_code"))),
            "truncated_at": limit,
        }
    )
    src, dst, many = F.col("source_suffix"), F.col("target_suffix"), F.coalesce("via_many", F.lit(False))
    remote = F.lit(mode == "remote")
    error = (
        F.when(F.col("cached").isNotNull(), None)
        .when(present(text).isNull(), "text_required")
        .when(dst.isNull(), "unsupported_target")
        .when(F.col("source_code").isNull(), "unsupported_source")
        .when(F.coalesce(src == dst, F.lit(False)), None)
        .when(remote & many, "remote_unsupported_source")
        .when(~remote & many & (dst == "pa"), "no_route_to_punjabi")
    )
    method = (
        F.when(F.col("cached").isNotNull(), "cached")
        .when(F.col("error").isNotNull(), None)
        .when(F.coalesce(src == dst, F.lit(False)), "no_translation_needed")
        .when(remote, "remote_mymemory")
        .when(many & (dst == "en"), "local_model_fallback_multilingual")
        .when(many, "local_model_fallback_multilingual_pivot_via_english")
        .when((src == "pa") | (dst == "pa"), "remote_libretranslate")
        .when((src == "en") | (dst == "en"), "local_model")
        .otherwise("local_model_pivot_via_english")
    )
    planned = staged.withColumn("error", error.cast("string")).withColumn("method", method)
    kept_whole = (F.col("method") == "no_translation_needed") | (F.col("cached") == text)
    return planned.withColumns(
        {
            "truncated_at": F.when(
                F.col("method").isNotNull() & ~F.coalesce(kept_whole, F.lit(False)), F.col("truncated_at")
            ),
            "remote_source": F.when(F.col("method") == "remote_mymemory", _lookup(REMOTE_CODES, F.col("source_code"))),
            "remote_target": F.when(F.col("method") == "remote_mymemory", _lookup(REMOTE_CODES, F.col("target_code"))),
        }
    )


# --- chunks ------------------------------------------------------------------------------
def _char_pieces(sentence: Column, limit: int) -> Column:
    """A sentence beyond the limit, filled character by character."""
    start = F.struct(F.array().cast("array<string>").alias("full"), F.lit("").alias("open"))

    def step(acc: Column, ch: Column) -> Column:
        over = F.octet_length(acc["open"]) + F.octet_length(ch) > limit
        return F.struct(
            F.when(over & (acc["open"] != ""), F.concat(acc["full"], F.array(acc["open"]))).otherwise(acc["full"]).alias("full"),
            F.when(over, ch).otherwise(F.concat(acc["open"], ch)).alias("open"),
        )

    return F.aggregate(
        F.split(sentence, ""), start, step, lambda acc: F.concat(acc["full"], F.array(acc["open"]))
    )


def chunk_text(text: Column, limit: int = CHUNK_BYTES) -> Column:
    """Chunks of at most ``limit`` UTF-8 bytes, cut at sentence ends where possible."""
    piece = lambda t, fresh: F.struct(t.alias("text"), F.lit(fresh).alias("fresh"))

    def pieces(t: Column) -> Column:
        sentences = F.filter(F.split(t, java(r"(?<=[.!?\n])\s+")), lambda s: s != "")
        return F.flatten(
            F.transform(
                sentences,
                lambda s: F.when(F.octet_length(s) <= limit, F.array(piece(s, False))).otherwise(
                    F.transform(_char_pieces(s, limit), lambda c: piece(c, True))
                ),
            )
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p["text"]).otherwise(F.concat_ws(" ", acc["open"], p["text"]))
        fits = ~p["fresh"] & (F.octet_length(joined) <= limit)
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(
            F.when(fits, acc["done"]).otherwise(closed).alias("done"),
            F.when(fits, joined).otherwise(p["text"]).alias("open"),
        )

    finish = lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(
        F.concat(acc["done"], F.array(acc["open"]))
    )

    def chunks(t: Column) -> Column:
        cut = let(
            F.aggregate(pieces(t), start, step, finish),
            lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.substring(t, 1, limit))),
        )
        return F.when(F.octet_length(t) <= limit, F.array(t)).otherwise(cut)

    return let(text, chunks)


def explode_chunks(df: DataFrame, key: list[str], text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """``(key, part, chunk)``."""
    return df.select(*key, F.posexplode(chunk_text(F.col(text), limit)).alias("part", "chunk"))


def join_chunks(parts: DataFrame, key: list[str], chunk: str = "chunk") -> DataFrame:
    """``(key, text)``: parts joined by blanks in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("part", chunk)))
    return parts.groupBy(*key).agg(
        F.array_join(F.transform(ordered, lambda p: p[chunk]), " ").alias("text")
    )


# --- applying a translator ----------------------------------------------------------------
Translator = Callable[[list[str], str, str], list[str]]


def translate(planned: DataFrame, key: list[str], translator: Translator) -> DataFrame:
    """``(key, translated, method, error, truncated_at)`` for planned requests.

    Only rows that need a model reach ``translator(texts, source, target)``; pivot routes
    call it twice, through English. Texts beyond what a model reads are cut into pieces at
    sentence ends (remote routes by bytes), all pieces are translated, and the results are
    joined by blanks in their order. The pieces of a text stay in its row, so nothing is
    shuffled.
    """
    needs = F.col("method").rlike("^(local_model|remote)")
    ready = planned.filter(F.coalesce(~needs, F.lit(True))).select(
        *key,
        F.when(F.col("method") == "cached", F.col("cached"))
        .when(F.col("method") == "no_translation_needed", F.col("text")).alias("translated"),
        "method", "error", "truncated_at",
    )
    given = planned.filter(needs).withColumn(
        "given",
        F.when(F.col("truncated_at").isNull(), F.col("text")).otherwise(
            F.substring(F.col("text"), F.lit(1), F.col("truncated_at"))
        ),
    )
    parts = (
        F.when(F.col("method") == "remote_mymemory", chunk_text(F.col("given")))
        .when(utf16_length(F.col("given")) <= MAX_CHARS, F.array("given"))
        .otherwise(chunk_text(F.col("given"), MAX_CHARS))
    )
    source = F.coalesce("remote_source", "source_suffix", "source_code")
    goal = F.coalesce("remote_target", "target_suffix")
    work = given.select(
        *key, "method", "error", "truncated_at", parts.alias("parts"),
        source.alias("source"), goal.alias("goal"), F.contains("method", F.lit("pivot")).alias("pivot"),
        F.coalesce(F.octet_length("given"), F.lit(0)).alias("size"),
    )
    route = ["source", "goal", "pivot"]
    most = WORKER_BYTES

    def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start, size = 0, 0
        for i, n in enumerate(batch.column("size").to_pylist()):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given_rows in (r for batch in batches for r in runs(batch)):
            # only what the translator reads becomes Python objects; the rest stays in Arrow
            batch = given_rows.select(["parts", *route]).to_pandas()
            translated = pd.Series(None, index=batch.index, dtype=object)
            for (src, dst, pivot), rows in batch.groupby(route).groups.items():
                pieces = batch.loc[rows, "parts"]
                texts = [piece for parts in pieces for piece in parts]
                for a, b in [(src, "en"), ("en", dst)] if pivot else [(src, dst)]:
                    texts = translator(texts, a, b)
                said = iter(texts)
                translated.loc[rows] = [" ".join(islice(said, len(parts))) for parts in pieces]
            said = pa.array(translated.tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([*(given_rows.column(c) for c in kept), said], names=[*kept, "translated"])
            pa.default_memory_pool().release_unused()

    kept = work.drop("parts", "size", *route).columns
    named = StructType([*work.select(*kept).schema.fields, StructField("translated", StringType())])
    done = work.mapInArrow(run, named)
    return ready.unionByName(done)


def translate_by_table(df: DataFrame, phrases: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``(key, translated)``: word by word through ``phrases(source, target, word, said)``.

    Expects ``source`` and ``target`` per row; unknown words stay. The different words of a
    text meet the phrases, and what is found comes back to the text in one row a key.
    """
    known = phrases.groupBy("source", "target", "word").agg(F.min("said").alias("said")).filter("said IS NOT NULL")
    lengths = known.agg(F.min(F.length("word")).alias("_least"), F.max(F.length("word")).alias("_most"))
    by = ["source", "target"]
    rows = df.select(*key, *by, F.col(text).alias("_text")).filter("_text IS NOT NULL")
    # each word of a text is looked up once, and only one that is as long as a phrase may be
    asked = rows.select(*key, *by, F.explode(F.array_distinct(F.split("_text", TOKEN_GAP))).alias("word")).join(
        F.broadcast(lengths), F.length("word").between(F.col("_least"), F.col("_most"))
    )
    hits = asked.join(known, [*by, "word"]).select(*key, F.struct(*by, "word", "said").alias("_hit"))
    every = rows.select(*key, F.struct(*by, "_text").alias("_row")).unionByName(hits, allowMissingColumns=True)
    # a key that comes again is one text, its words in turn
    found = every.groupBy(*key).agg(F.collect_list("_row").alias("_rows"), F.collect_list("_hit").alias("_hits"))
    line = lambda r: F.regexp_replace(r["_text"], WS_RUN, " ").alias("line")
    texts = F.transform("_rows", lambda r: F.struct(*[r[c] for c in by], line(r)))
    return found.select(*key, _spoken()(texts, F.col("_hits")).alias("translated"))


def _spoken():
    """Function of texts, their words parted by one blank, and the phrases found in them. It
    refers to nothing of this package, so workers need not import it."""

    def columns(lists: pa.ListArray) -> tuple[list[int], list[list]]:
        """Ends of the rows' lists, and the fields of all their members."""
        ends = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        return ends.tolist(), [c.to_pylist() for c in lists.flatten().flatten()]

    def say(texts: pa.ListArray, hits: pa.ListArray) -> Iterator[str]:
        (text_ends, lines), (hit_ends, found) = columns(texts), columns(hits)
        t = h = 0
        for text_end, hit_end in zip(text_ends, hit_ends):
            known: dict[tuple, dict[str, str]] = {}
            for source, target, word, told in zip(*(c[h:hit_end] for c in found)):
                known.setdefault((source, target), {})[word] = told
            said = []
            for source, target, line in zip(*(c[t:text_end] for c in lines)):
                phrases = known.get((source, target), {})
                said.append([phrases.get(w, w) for w in line.split(" ")])
            if len(said) > 1:
                said = [[w for _, w in sorted((i, w) for words in said for i, w in enumerate(words))]]
            yield " ".join(said[0])
            t, h = text_end, hit_end

    @F.arrow_udf("string")
    def spoken(texts: pa.Array, hits: pa.Array) -> pa.Array:
        step = 256  # rows that are Python objects at once
        parts = range(0, len(texts), step)
        return pa.array([w for a in parts for w in say(texts.slice(a, step), hits.slice(a, step))], pa.string())

    return spoken
