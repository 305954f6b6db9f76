"""Cleaning, quality, language and label rules over documents, pages and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import labels, language, quality, rules, text
from postlens.functions.patterns import WS, re2, squeeze
from postlens.operators import language_id, upsert
from postlens.operators.sentiment import default_lexicon, sentiment_by_lexicon
from postlens.plans.fixture import posts, read
from postlens.plans.registry import query


def q(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def rep(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(re2(pattern))}, {q(to)}, 'g')"


def chain(expr: str, *rules_: tuple[str, str]) -> str:
    for pattern, to in rules_:
        expr = rep(expr, pattern, to.replace("$", "\\"))
    return expr


def sql_squeeze(expr: str) -> str:
    return f"trim({rep(f'coalesce({expr}, {q('')})', WS + '+', ' ')})"


def sql_trim(expr: str) -> str:
    return rep(expr, f"^{WS}+|{WS}+$", "")


STRIP_HTML = lambda e: sql_squeeze(chain(e, *text.ESCAPED_MARKUP, ("<[^>]*>", " "), *text.BASIC_ENTITIES))
STRIP_URLS = lambda e: sql_trim(chain(e, (text.URL, " ")))
NOISE = lambda e: sql_squeeze(
    chain(e, (text.URL, " "), (text.TAG_OR_MENTION_ANY_SCRIPT, " "), (r"[^\p{L}\p{M}\s'’]", " "))
)
WORD_CLASS = lambda e: sql_squeeze(rep(f"lower(coalesce({e}, ''))", r"[^\p{L}\p{N}\s]", " "))


def pages(spark, d):
    return read(spark, d, "pages")


def docs(spark, d):
    return read(spark, d, "documents")


@query("t1_strip_html", f"SELECT page_id, {STRIP_HTML('html')} AS clean FROM pages", with_posts=False)
def _(spark, d):
    return pages(spark, d).select("page_id", text.strip_html(F.col("html")).alias("clean"))


@query("t2_decode_html")
def _(spark, d):
    return pages(spark, d).select("page_id", text.decode_html(F.col("html")).alias("clean"))


@query("t3_clean_markup")
def _(spark, d):
    return pages(spark, d).select("page_id", text.clean_markup(F.col("html")).alias("clean"))


@query("t4_strip_urls", f"SELECT page_id, {STRIP_URLS('html')} AS clean FROM pages", with_posts=False)
def _(spark, d):
    return pages(spark, d).select("page_id", text.strip_urls(F.col("html")).alias("clean"))


@query("t5_strip_tags_mentions",
       f"SELECT doc_id, {rep('text', text.TAG_OR_MENTION, ' ')} AS clean FROM documents", with_posts=False)
def _(spark, d):
    return docs(spark, d).select("doc_id", text.strip_tags_and_mentions(F.col("text")).alias("clean"))


@query("t6_strip_language_noise", f"SELECT doc_id, {NOISE('text')} AS clean FROM documents", with_posts=False)
def _(spark, d):
    return docs(spark, d).select("doc_id", text.strip_language_noise(F.col("text")).alias("clean"))


@query("t7_normalize_space", f"""SELECT page_id, md5({sql_squeeze('html')}) AS kept,
 md5({sql_squeeze('lower(html)')}) AS lowered, {WORD_CLASS('html')} AS word_class FROM pages""", with_posts=False)
def _(spark, d):
    html = F.col("html")
    return pages(spark, d).select(
        "page_id", F.md5(squeeze(html)).alias("kept"), F.md5(text.lower_squeeze(html)).alias("lowered"),
        text.word_class_squeeze(html).alias("word_class"),
    )


@query("t8_clean_platform_noise")
def _(spark, d):
    return docs(spark, d).select("doc_id", text.clean_platform_noise(F.col("text")).alias("clean"))


@query("t9_collapse_repeats")
def _(spark, d):
    return docs(spark, d).select("doc_id", text.collapse_repeats(F.col("text")).alias("clean"))


@query("t10_title", f"""SELECT id, coalesce(list_filter(list_transform(
   regexp_split_to_array({sql_trim('original_text')}, '\\r?\\n'), lambda l: {sql_trim('l')}),
   lambda l: l <> '')[1], '') AS title FROM posts""")
def _(spark, d):
    return posts(spark, d).select("id", text.title_of(F.col("original_text")).alias("title"))


@query("t11_sentence_helpers", f"""WITH s AS (SELECT doc_id, {sql_squeeze('text')} AS t FROM documents)
 SELECT doc_id, CAST(len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS BIGINT) AS words,
 upper(t[1:1]) || t[2:] AS capitalized,
 CASE WHEN t = '' OR regexp_matches(t, '[.!?…]$') THEN t ELSE t || '.' END AS ended FROM s""", with_posts=False)
def _(spark, d):
    t = F.col("text")
    return docs(spark, d).select(
        "doc_id", text.word_count(t).cast("bigint").alias("words"),
        text.capitalize(t).alias("capitalized"), text.end_sentence(t).alias("ended"),
    )


@query("t12_limit_words")
def _(spark, d):
    return docs(spark, d).select("doc_id", text.limit_words(F.col("text"), 35).alias("short"))


# --- quality -----------------------------------------------------------------------------
# characters above U+FFFF take two UTF-16 units
U16 = lambda e: f"(length({e}) + length(regexp_replace({e}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
STOPS = ", ".join(q(w) for w in rules.REPEAT_STOP_WORDS)


# runs of one character, counted where each character stands alone in a row
_RUNS = f"""h AS MATERIALIZED (SELECT doc_id, {STRIP_HTML('text')} AS t FROM documents),
 ch AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS island
   FROM (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM h)),
 ru AS (SELECT doc_id, sum(n) AS hits FROM (SELECT doc_id, c, island, count(*) AS n FROM ch GROUP BY ALL)
   WHERE n >= 4 AND ord(c) <= 65535 GROUP BY ALL),
 g1 AS (SELECT doc_id, t, CASE WHEN t = '' THEN 0.0 ELSE coalesce(hits, 0) / {U16('t')} END::DOUBLE AS ratio
   FROM h LEFT JOIN ru USING (doc_id))"""


@query("g1_repeated_char_ratio", f"WITH {_RUNS} SELECT doc_id, round(ratio, 6) AS ratio FROM g1", with_posts=False)
def _(spark, d):
    return docs(spark, d).select(
        "doc_id", F.round(quality.repeated_char_ratio(text.strip_html(F.col("text"))), 6).alias("ratio")
    )


@query("g2_symbol_ratio", f"""WITH s AS (SELECT doc_id, {STRIP_HTML('text')} AS t FROM documents),
 r AS (SELECT doc_id, t, {rep('t', r'[\p{L}\p{N}\s]', '')} AS rest FROM s)
 SELECT doc_id, CASE WHEN t = '' THEN 0.0 ELSE round({U16('rest')} / {U16('t')}, 6) END::DOUBLE AS ratio FROM r""",
       with_posts=False)
def _(spark, d):
    return docs(spark, d).select(
        "doc_id", F.round(quality.symbol_ratio(text.strip_html(F.col("text"))), 6).alias("ratio")
    )


_REPEATED_WORDS = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(
   lower({STRIP_HTML('text')}), '\\b[\\p{{L}}\\p{{N}}]+\\b')) AS word FROM documents),
 m AS (SELECT * FROM w WHERE length(word) >= 3 AND word NOT IN ({STOPS})),
 c AS (SELECT doc_id, word, count(*) AS n FROM m GROUP BY ALL),
 r AS (SELECT doc_id, sum(n) AS total, coalesce(sum(n) FILTER (n >= 3), 0) AS hits FROM c GROUP BY ALL)"""


@query("g3_repeated_word_ratio", f"""WITH {_REPEATED_WORDS}
 SELECT doc_id, CASE WHEN coalesce(total, 0) < 4 THEN 0.0 ELSE round(hits / total, 6) END::DOUBLE AS ratio
 FROM documents LEFT JOIN r USING (doc_id)""", with_posts=False)
def _(spark, d):
    return docs(spark, d).select(
        "doc_id", F.round(quality.repeated_word_ratio(text.strip_html(F.col("text"))), 6).alias("ratio")
    )


@query("g4_too_short", f"""WITH s AS (SELECT doc_id, {STRIP_URLS(STRIP_HTML('text'))} AS t FROM documents)
 SELECT doc_id, {U16('t')} < 15 AS too_short FROM s""", with_posts=False)
def _(spark, d):
    return docs(spark, d).select("doc_id", quality.too_short(text.strip_html(F.col("text"))).alias("too_short"))


@query("g5_text_quality", f"""WITH {_RUNS}, {_REPEATED_WORDS},
 y AS (SELECT doc_id, {U16(STRIP_URLS('t'))} < 15 AS short, ratio > 0.3 AS chars,
   t <> '' AND {U16(rep('t', r'[\p{L}\p{N}\s]', ''))} / greatest({U16('t')}, 1) > 0.5 AS symbols,
   coalesce(total >= 4 AND hits / total > 0.5, false) AS repeats FROM g1 LEFT JOIN r USING (doc_id)),
 z AS (SELECT *, CAST(2 * short::INT + 4 * chars::INT + 4 * symbols::INT + 4 * repeats::INT AS BIGINT) AS score FROM y)
 SELECT doc_id, score >= 4 AS is_gibberish, score, concat_ws(',', CASE WHEN short THEN 'too_short' END,
   CASE WHEN chars THEN 'repeated_characters' END, CASE WHEN symbols THEN 'high_symbol_ratio' END,
   CASE WHEN repeats THEN 'repeated_words' END) AS reasons FROM z""", with_posts=False)
def _(spark, d):
    out = quality.text_quality(docs(spark, d), "text")
    return out.select(
        "doc_id", "is_gibberish", F.col("quality_score").alias("score"),
        F.array_join("quality_reasons", ",").alias("reasons"),
    )


# --- language ----------------------------------------------------------------------------
_SCRIPT_COUNTS = ", ".join(
    f"struct_pack(n := len(regexp_extract_all(t, {q(f'[{block}]')})), o := {-i}, code := {q(code)})"
    for i, (code, block) in enumerate(rules.SCRIPT_BLOCKS)
)
_LATIN = ", ".join(q(code) for code in rules.LATIN_LANGUAGES)


@query("l1_dominant_script", f"""WITH s AS (SELECT doc_id, {rep('text', text.TAG_OR_MENTION, ' ')} AS t FROM documents),
 c AS (SELECT doc_id, len(regexp_extract_all(t, '\\p{{L}}')) AS letters,
   list_max([{_SCRIPT_COUNTS}]) AS best FROM s)
 SELECT doc_id, CASE WHEN letters > 0 AND best.n >= 6 AND best.n / letters >= 0.15 THEN best.code END AS script
 FROM c""", with_posts=False)
def _(spark, d):
    return docs(spark, d).select("doc_id", language.dominant_script(F.col("text")).alias("script"))


@query("l2_refine_latin", f"""WITH s AS (SELECT doc_id, lang, {NOISE('text')} AS t FROM documents),
 r AS (SELECT *, len(regexp_extract_all(t, '\\p{{L}}')) AS letters,
   len(regexp_extract_all(t, '\\p{{Latin}}')) AS latin FROM s)
 SELECT doc_id, CASE WHEN letters = 0 OR latin / letters < 0.5 THEN 'und'
   WHEN {U16('t')} >= 20 AND lang IN ('en', 'de') THEN CASE lang WHEN 'en' THEN 'eng' ELSE 'deu' END
   ELSE 'eng' END AS settled FROM r""", with_posts=False)
def _(spark, d):
    # second opinion: known for two languages, one outside the list for the others
    second = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "de", "deu").otherwise("por")
    return docs(spark, d).select(
        "doc_id", language.refine_latin(F.col("text"), F.lit("und"), second).alias("settled")
    )


def sql_trigram_counts(source: str, group: str, expr: str) -> str:
    letters = rep(f"lower({expr})", r"[^\p{L}\p{M}]+", " ")
    return f"""(SELECT {group}, tri, sum(n) AS n FROM (
   SELECT {group}, n, unnest(list_transform(range(1, length(w) + 1),
     lambda i: substr(' ' || w || ' ', i, 3))) AS tri
   FROM (SELECT {group}, w, count(*) AS n FROM (
     SELECT {group}, unnest(string_split({letters}, ' ')) AS w FROM {source}) WHERE w <> '' GROUP BY ALL)) GROUP BY ALL)"""


def sql_ranked(counts: str, group: str) -> str:
    return f"""(SELECT {group}, tri, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, tri) - 1 AS rank
   FROM {counts} QUALIFY rank < 300)"""


_PROFILES = sql_ranked(sql_trigram_counts("documents", "lang", "text"), "lang")
_DISTANCES = f"""p AS {_PROFILES},
 o AS {sql_ranked(sql_trigram_counts(f"(SELECT doc_id, text FROM documents WHERE {U16('text')} >= 10)", "doc_id", "text"), "doc_id")},
 z AS (SELECT doc_id, count(*) AS size FROM o GROUP BY doc_id),
 s AS (SELECT o.doc_id, p.lang, sum(300 - abs(o.rank - p.rank)) AS saved FROM o JOIN p USING (tri) GROUP BY ALL),
 d AS (SELECT doc_id, lang, CAST(size * 300 - saved AS BIGINT) AS distance FROM s JOIN z USING (doc_id))"""


@query("l3_train_profiles", f"SELECT lang, tri, rank FROM {_PROFILES}", with_posts=False)
def _(spark, d):
    out = language_id.train_profiles(docs(spark, d))
    return out.select("lang", "tri", F.col("rank").cast("bigint").alias("rank"))


@query("l3_identify", f"""WITH {_DISTANCES}
 SELECT doc_id, arg_min(lang, (distance, lang)) AS lang FROM d GROUP BY doc_id""", with_posts=False)
def _(spark, d):
    profiles = language_id.train_profiles(docs(spark, d))
    return language_id.identify(docs(spark, d), profiles, ["doc_id"], F.col("text"))


@query("l4_ranked_languages", f"""WITH {_DISTANCES}
 SELECT doc_id, lang, distance, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS place FROM d""",
       with_posts=False)
def _(spark, d):
    profiles = language_id.train_profiles(docs(spark, d))
    out = language_id.rank_languages(docs(spark, d), profiles, ["doc_id"], F.col("text"))
    return out.withColumn("place", F.col("place").cast("bigint"))


def _iso3(spark, d):
    """Profiles named by ISO 639-3 codes, as the posts table uses them."""
    code = F.element_at(
        F.create_map(*[F.lit(x) for x in ("en", "eng", "de", "deu", "fr", "fra", "es", "spa")]), F.col("lang")
    )
    return language_id.train_profiles(docs(spark, d).withColumn("lang", code))


# script, then both identifications of every text that is asked, each in full
_DECIDED = f"""pt AS MATERIALIZED (SELECT id, platform, post_id, {STRIP_URLS(STRIP_HTML('original_text'))} AS plain FROM posts),
 sc AS (SELECT *, {rep('plain', text.TAG_OR_MENTION, ' ')} AS t, {NOISE('plain')} AS noise FROM pt),
 sb AS (SELECT *, len(regexp_extract_all(t, '\\p{{L}}')) AS letters, list_max([{_SCRIPT_COUNTS}]) AS best FROM sc),
 ss AS MATERIALIZED (SELECT id, platform, post_id, plain, noise,
   CASE WHEN letters > 0 AND best.n >= 6 AND best.n / letters >= 0.15 THEN best.code END AS script FROM sb),
 sk AS MATERIALIZED (SELECT *, script IS NULL AND {U16('plain')} >= 20 AS asked,
   len(regexp_extract_all(noise, '\\p{{L}}')) AS nl, len(regexp_extract_all(noise, '\\p{{Latin}}')) AS latin FROM ss),
 iso AS (SELECT CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' END
   AS lang, text FROM documents),
 p AS {sql_ranked(sql_trigram_counts("iso", "lang", "text"), "lang")},
 o AS {sql_ranked(sql_trigram_counts('''(SELECT id, 0 AS kind, plain AS body FROM sk WHERE asked
   UNION ALL SELECT id, 1, noise FROM sk WHERE asked)''', "id, kind", "body"), "id, kind")},
 oz AS (SELECT id, kind, count(*) AS size FROM o GROUP BY ALL),
 os AS (SELECT o.id, o.kind, p.lang, sum(300 - abs(o.rank - p.rank)) AS saved FROM o JOIN p USING (tri) GROUP BY ALL),
 od AS (SELECT id, arg_min(lang, (size * 300 - saved, lang)) FILTER (kind = 0) AS first,
   arg_min(lang, (size * 300 - saved, lang)) FILTER (kind = 1) AS second FROM os JOIN oz USING (id, kind) GROUP BY id),
 decided AS (SELECT platform, post_id, coalesce(script, CASE WHEN first IS NULL THEN NULL
     WHEN nl = 0 OR latin / nl < 0.5 THEN first WHEN {U16('noise')} >= 20 AND second IN ({_LATIN}) THEN second
     ELSE 'eng' END) AS new_language, CASE WHEN asked THEN first IS NOT NULL END AS identified
   FROM sk LEFT JOIN od USING (id))"""


@query("l5_decide_language", f"WITH {_DECIDED} SELECT platform, post_id, new_language, identified FROM decided")
def _(spark, d):
    out = language_id.decide_language(posts(spark, d), _iso3(spark, d), upsert.KEY)
    return out.select("platform", "post_id", "new_language", "identified")


@query("k6_backfill_language", f"""WITH {_DECIDED} SELECT platform, post_id, 'eng' AS language, new_language
 FROM decided WHERE new_language IS DISTINCT FROM 'eng'""")
def _(spark, d):
    table = posts(spark, d)
    found = language_id.decide_language(table, _iso3(spark, d), upsert.KEY)
    # the texts hold four languages, so a stored language of 'eng' is often wrong
    stored = table.withColumn("language", F.lit("eng"))
    return upsert.backfill_language(stored, found).select("platform", "post_id", "language", "new_language")


# --- labels ------------------------------------------------------------------------------
_CONTAINED = lambda terms: "coalesce(" + ", ".join(
    f"CASE WHEN contains(t, {q(x)}) THEN {q(x)} END" for x in terms) + ")"
_ANY = lambda patterns: q(re2("|".join(f"(?:{p})" for p in patterns)))


@query("r1_relevance", f"""WITH s AS (SELECT id, {sql_squeeze('lower(original_text)')} AS t FROM posts),
 m AS (SELECT id, t, {_CONTAINED(rules.OFF_TOPIC)} AS off, {_CONTAINED(rules.RELATED_TERMS)} AS rel FROM s),
 v AS (SELECT *, CASE WHEN t = '' THEN 'empty_text' WHEN off IS NOT NULL THEN 'irrelevant_passport_usage'
   WHEN regexp_matches(t, {_ANY(rules.ON_TOPIC)}) THEN 'passport_context_detected'
   WHEN contains(t, 'passport') THEN 'passport_without_meaningful_context'
   WHEN rel IS NOT NULL THEN 'related_topic_without_passport_context'
   ELSE 'no_passport_topic_term' END AS reason FROM m)
 SELECT id, reason = 'passport_context_detected' AS is_relevant, reason,
 CASE reason WHEN 'irrelevant_passport_usage' THEN off
   WHEN 'related_topic_without_passport_context' THEN rel END AS matched FROM v""")
def _(spark, d):
    verdict = labels.relevance(F.col("original_text")).alias("v")
    return posts(spark, d).select("id", verdict).select("id", "v.is_relevant", "v.reason", "v.matched")


_CATEGORY_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(t, {_ANY(ps)}) THEN {q(name)}" for name, ps in rules.CATEGORY_RULES.items()
) + " END"


@query("c1_rule_category", f"""WITH s AS (SELECT id, lower({sql_squeeze('original_text')}) AS t FROM posts),
 c AS (SELECT id, t, {_CATEGORY_CASE} AS category FROM s)
 SELECT id, category, CASE WHEN category IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS score,
 CASE WHEN t = '' THEN 'none' WHEN category IS NOT NULL THEN 'domain_rule' END AS method FROM c""")
def _(spark, d):
    label = labels.rule_category(F.col("original_text")).alias("c")
    return posts(spark, d).select("id", label).select("id", "c.category", "c.score", "c.method")


_LEXICON = "CASE w " + " ".join(
    f"WHEN {q(w)} THEN {score}" for score, ws in rules.LEXICON.items() for w in ws.split()
) + " ELSE 0 END"
_SENTIMENT = f"""WITH s AS (SELECT id, list_filter(string_split({sql_squeeze(
    "regexp_replace(lower(original_text), '[\n.,/#!?$%^&*;:{}=_`\"~()]', ' ', 'g')")}, ' '), lambda w: w <> '') AS ws FROM posts),
 u AS (SELECT id, unnest(ws) AS w, unnest(list_concat([''], ws[:-2])) AS p FROM s),
 t AS (SELECT id, sum({_LEXICON} * CASE WHEN p IN ({", ".join(q(n) for n in rules.NEGATORS)}) THEN -1 ELSE 1 END) AS total
   FROM u GROUP BY id)
 SELECT id, CAST(coalesce(total, 0) AS BIGINT) AS score, CASE WHEN total > 1 THEN 'Positive'
   WHEN total < -1 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM posts LEFT JOIN t USING (id)"""


@query("n1_sentiment", _SENTIMENT)
def _(spark, d):
    score = labels.sentiment_score(F.col("original_text")).alias("score")
    return posts(spark, d).select("id", score).withColumn("sentiment", labels.sentiment_label(F.col("score")))


@query("n1_sentiment_lexicon_table", _SENTIMENT)
def _(spark, d):
    return sentiment_by_lexicon(posts(spark, d), default_lexicon(spark), ["id"])


_REGION_CASE = "CASE " + " ".join(
    "WHEN regexp_matches(t, {}) THEN {}".format(
        q(r"(^|[^\p{L}\p{N}])(" + "|".join(k.replace(".", r"\.") for k in ks) + r")([^\p{L}\p{N}]|$)"), q(name)
    )
    for name, ks in rules.REGION_KEYWORDS.items()
) + " END"


@query("rg1_region", f"""WITH s AS (SELECT id, {sql_squeeze('lower(original_text)')} AS t FROM posts)
 SELECT id, {_REGION_CASE} AS region FROM s""")
def _(spark, d):
    return posts(spark, d).select("id", labels.region(F.col("original_text")).alias("region"))
