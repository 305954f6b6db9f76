"""Summaries over posts, documents and conversations, and the guards over pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import rules
from postlens.functions import summary as S
from postlens.functions.patterns import re2, squeeze
from postlens.functions.text import word_count
from postlens.operators import summarize
from postlens.plans.fixture import posts, read
from postlens.plans.registry import query
from postlens.plans.text_queries import q, rep, sql_squeeze

STOPS = ", ".join(q(w) for w in rules.SUMMARY_STOP_WORDS)
_PLAIN = lambda e: rep(f"lower({sql_squeeze(e)})", r"[^\p{L}\p{N}\s]", " ")
_NO_LINKS = lambda e: rep(f"lower({sql_squeeze(e)})", r"https?://\S+", " ")
COMPARISON = lambda e: f"list_filter(string_split({_PLAIN(e)}, ' '), lambda w: length(w) > 2)"
CONTENT = lambda e: f"""list_filter(string_split({rep(_NO_LINKS(e), r'[^\p{L}\p{N}\s]', ' ')}, ' '),
   lambda w: length(w) > 2 AND w NOT IN ({STOPS}))"""


def turns(spark, d):
    return read(spark, d, "conversations")


TURN = ["conv_id", "turn"]


@query("m1_author_tldr")
def _(spark, d):
    # every conversation turn, told again by an author who closes with a short version
    told = F.concat_ws(" ", F.lit("Long story."), F.col("text"), F.lit("TL;DR:"), F.substring_index("text", " ", 12))
    return turns(spark, d).select(*TURN, S.author_tldr(told).alias("tldr"))


@query("m2_sentences", f"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(
   {rep(sql_squeeze('text'), r'([.!?])\s+([A-ZÀ-ÖØ-Þ0-9"“‘])', chr(92) + '1' + chr(1) + chr(92) + '2')}, '{chr(1)}'),
   lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)
 SELECT conv_id, turn, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS idx, unnest(l) AS sentence FROM s""",
       with_posts=False)
def _(spark, d):
    split = S.split_sentences(squeeze(F.col("text")))
    return turns(spark, d).select(*TURN, F.posexplode(split).alias("idx", "sentence"))


@query("m3_tokens", f"""SELECT conv_id, turn, array_to_string({CONTENT('text')}, ' ') AS content,
 array_to_string({COMPARISON('text')}, ' ') AS comparison FROM conversations""", with_posts=False)
def _(spark, d):
    text = F.col("text")
    return turns(spark, d).select(
        *TURN, F.array_join(S.content_tokens(text), " ").alias("content"),
        F.array_join(S.comparison_tokens(text), " ").alias("comparison"),
    )


_HIT = lambda pattern: f"regexp_matches(t, {q(re2(pattern))})"
_CUES = " + ".join(f"CASE WHEN {_HIT(p)} THEN {n} ELSE 0 END" for p, n in S.PROMOTION_CUES)


@query("m4_post_types", f"""WITH s AS (SELECT id, original_text AS o, {sql_squeeze('original_text')} AS t FROM posts)
 SELECT id, contains(t, '?') OR {_HIT(S.QUESTION_START)} AS question, {_CUES} >= 3 AS promotional,
 {_HIT(S.COMPLAINT).replace("(t,", "(o,")} AS complaint, {_HIT(S.FIRST_PERSON).replace("(t,", "(o,")} AS first_person FROM s""")
def _(spark, d):
    text = F.col("original_text")
    return posts(spark, d).select(
        "id", S.is_question(text).alias("question"), S.is_promotional(text).alias("promotional"),
        S.is_complaint(text).alias("complaint"), S.is_first_person(text).alias("first_person"),
    )


@query("m5_sentence_scores")
def _(spark, d):
    scored = summarize.score_sentences(summarize.placed(posts(spark, d), ["id"], "original_text"), ["id"])
    # the outer form: the other one lets the engine test the size first, at the cost of all scores
    rows = scored.select("id", F.inline_outer("scored")).filter(F.col("idx").isNotNull())
    return rows.select("id", "idx", "words", F.round("score", 6).alias("score"))


@query("m6_core_sentences")
def _(spark, d):
    core = summarize.core_sentences(posts(spark, d), ["id"], "original_text")
    return core.select("id", F.array_join("core", " ").alias("core"))


@query("m7_rewriting")
def _(spark, d):
    told = S.third_person(S.strip_fillers(S.drop_padding(F.col("text"))))
    return turns(spark, d).select(*TURN, told.alias("told"), S.frame(F.col("text")).alias("frame"))


_CAPITAL = lambda e: f"(upper(substr({sql_squeeze(e)}, 1, 1)) || substr({sql_squeeze(e)}, 2))"
_ENDED = lambda e: f"CASE WHEN {e} = '' OR regexp_matches({e}, '[.!?…]$') THEN {e} ELSE {e} || '.' END"
_QUESTION = lambda e: f"(contains({e}, '?') OR regexp_matches({e}, {q(re2(S.QUESTION_START))}))"
_WORDS = lambda e: f"list_filter(string_split({e}, ' '), lambda x: x <> '')"


@query("m8_tiny_label", f"""WITH s AS (SELECT conv_id, turn, {sql_squeeze('text')} AS t FROM conversations),
 c AS (SELECT *, {_CAPITAL('t')} AS cap, trim(regexp_replace(t, '[.!?]+$', '')) AS subject FROM s)
 SELECT conv_id, turn, CASE WHEN t = '' OR len({_WORDS('t')}) > 8 THEN NULL
   WHEN regexp_matches(t, '[.!?]$') AND len({_WORDS('t')}) >= 4 THEN {_ENDED('cap')}
   WHEN NOT regexp_matches(subject, '[\\p{{L}}\\p{{N}}]') THEN {_ENDED('cap')}
   ELSE CASE WHEN {_QUESTION('t')} THEN 'Short post asking about ' ELSE 'Short post about ' END
     || lower(substr(subject, 1, 1)) || substr(subject, 2) || '.' END AS label FROM c""", with_posts=False)
def _(spark, d):
    # the label is for tiny posts: whole turns of at most 8 words, null for the others
    whole = squeeze(F.col("text"))
    label = F.when(word_count(whole) <= S.TINY_POST_WORDS, S.tiny_label(whole, whole))
    return turns(spark, d).select(*TURN, label.alias("label"))


@query("m9_compress")
def _(spark, d):
    return summarize.compress(posts(spark, d), ["id"])


@query("m10_summarize")
def _(spark, d):
    return summarize.summarize(posts(spark, d), ["id"])


@query("m10_summarize_with_candidates")
def _(spark, d):
    table = posts(spark, d)
    # stands for the texts a model wrote: the stored summaries
    given = table.select("id", F.col("summary").alias("candidate"))
    return summarize.summarize(table, ["id"], candidates=given)


@query("m11_model_input")
def _(spark, d):
    out = summarize.model_input(posts(spark, d), ["id"])
    return out.select("id", F.length("condensed").alias("chars"), F.md5("condensed").alias("condensed"))


def pairs(spark, d):
    return posts(spark, d).filter(F.col("summary").isNotNull()).select(
        "id", F.col("original_text").alias("source"), "summary"
    )


_PAIRS = "pairs AS (SELECT id, original_text AS source, summary FROM posts WHERE summary IS NOT NULL)"


def _degenerate(w):
    """A word or phrase of up to four words said twice in a row, in the list ``w``."""
    twice = lambda n: f"""len(list_filter(range(1, len({w}) - {2 * n - 2}), lambda i: {w}[i:i + {n - 1}] = {w}[i + {n}:i + {2 * n - 1}]
      AND length(array_to_string({w}[i:i + {n - 1}], ' ')) > {2 if n == 1 else 8})) > 0"""
    return "(" + " OR ".join(twice(n) for n in (1, 2, 3, 4)) + ")"


_SPOKEN = lambda e: _WORDS(sql_squeeze(f"regexp_replace(lower({sql_squeeze(e)}), '[-–—]', ' ', 'g')"))


@query("m12_degenerate", f"""WITH s AS (SELECT conv_id, turn, {_SPOKEN('text')} AS w FROM conversations)
 SELECT conv_id, turn, {_degenerate('w')} AS degenerate FROM s""", with_posts=False)
def _(spark, d):
    return turns(spark, d).select(*TURN, S.degenerate(F.col("text")).alias("degenerate"))


@query("m13_copied_phrase", f"""WITH {_PAIRS}, t AS (SELECT id, {COMPARISON('source')} AS src,
   {COMPARISON('summary')} AS s FROM pairs),
 g AS (SELECT id, list_transform(range(1, len(s) - 4), lambda i: s[i:i + 5]) AS grams,
   list_transform(range(1, len(src) - 4), lambda i: src[i:i + 5]) AS known, len(s) AS n, len(src) AS m FROM t)
 SELECT id, n >= 8 AND m >= 12 AND
   len(list_filter(grams, lambda x: list_contains(known, x))) / greatest(len(grams), 1) >= 0.55 AS copied FROM g""")
def _(spark, d):
    return pairs(spark, d).select("id", S.copied_phrase(F.col("source"), F.col("summary")).alias("copied"))


@query("m14_verbatim_prefix", f"""WITH {_PAIRS}, t AS (SELECT id, {COMPARISON('source')} AS src,
   {COMPARISON('summary')} AS s FROM pairs)
 SELECT id, len(s) >= 8 AND src[1:len(s)] = s AS verbatim FROM t""")
def _(spark, d):
    return pairs(spark, d).select("id", S.verbatim_prefix(F.col("source"), F.col("summary")).alias("verbatim"))


@query("m15_unfaithful", f"""WITH {_PAIRS}, t AS (SELECT id, {CONTENT('summary')} AS src, {CONTENT('source')} AS s,
   list_transform(regexp_extract_all(summary, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.')) AS a,
   list_transform(regexp_extract_all(source, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.')) AS b
   FROM pairs)
 SELECT id, len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 OR (len(s) > 0 AND
   len(list_filter(s, lambda t: len(list_filter(src, lambda x: starts_with(x, t[1:5]) OR starts_with(t, x[1:5]))) = 0))
   / greatest(len(s), 1) > 0.34) AS unfaithful FROM t""")
def _(spark, d):
    # the short text as source and the long one as its summary, so that both answers occur
    return pairs(spark, d).select("id", S.unfaithful(F.col("summary"), F.col("source")).alias("unfaithful"))


_GUARDS = f"""t AS (SELECT id, source, summary, {_SPOKEN('summary')} AS w,
   {sql_squeeze('source')} AS long_text, {sql_squeeze('summary')} AS short_text, {COMPARISON('source')} AS src,
   {COMPARISON('summary')} AS s, {CONTENT('source')} AS known, {CONTENT('summary')} AS told,
   list_transform(regexp_extract_all(source, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.')) AS a,
   list_transform(regexp_extract_all(summary, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.')) AS b FROM pairs),
 g AS (SELECT *, list_transform(range(1, len(s) - 4), lambda i: s[i:i + 5]) AS grams,
   list_transform(range(1, len(src) - 4), lambda i: src[i:i + 5]) AS runs FROM t),
 f AS (SELECT id, {_degenerate('w')} AS degenerate,
   len(s) >= 8 AND len(src) >= 12 AND
     len(list_filter(grams, lambda x: list_contains(runs, x))) / greatest(len(grams), 1) >= 0.55 AS copied,
   len(s) >= 8 AND src[1:len(s)] = s AS verbatim,
   len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0 OR (len(told) > 0 AND
     len(list_filter(told, lambda v: len(list_filter(known, lambda x: starts_with(x, v[1:5]) OR starts_with(v, x[1:5]))) = 0))
     / greatest(len(told), 1) > 0.34) AS unfaithful,
   len({_WORDS('short_text')}) < 7 AND len({_WORDS('long_text')}) > 18 AS too_few_words,
   {_QUESTION('long_text')} AND NOT contains(summary, '?') AS lost_question FROM g)
 SELECT *, degenerate OR copied OR verbatim OR unfaithful OR too_few_words OR lost_question AS rejected FROM f"""


@query("m16_summary_guards", f"WITH {_PAIRS}, {_GUARDS}")
def _(spark, d):
    return summarize.summary_guards(pairs(spark, d)).drop("source", "summary")


# Summaries other than a post's own start: the next post's, every second word, and words in
# reverse with a number the text does not have.
_RETOLD = """pairs AS (SELECT * FROM (SELECT p.id, p.original_text AS source, CASE p.id % 4 WHEN 0 THEN p.summary
   WHEN 1 THEN array_to_string(string_split(n.original_text, ' ')[1:15], ' ')
   WHEN 2 THEN array_to_string([string_split(p.original_text, ' ')[i] FOR i IN range(1, least(40, len(string_split(p.original_text, ' '))) + 1, 2)], ' ')
   ELSE array_to_string(list_reverse(string_split(p.original_text, ' ')[1:20]), ' ') || ' 12345' END AS summary
   FROM posts p LEFT JOIN posts n ON n.id = p.id + 1) WHERE summary IS NOT NULL)"""


def retold(spark, d):
    table = posts(spark, d)
    following = table.select((F.col("id") - 1).alias("id"), F.col("original_text").alias("next"))
    words = F.split("original_text", " ")
    summary = (
        F.when(F.col("id") % 4 == 0, F.col("summary"))
        .when(F.col("id") % 4 == 1, F.array_join(F.slice(F.split("next", " "), 1, 15), " "))
        .when(F.col("id") % 4 == 2, F.array_join(F.filter(F.slice(words, 1, 40), lambda w, i: i % 2 == 0), " "))
        .otherwise(F.concat(F.array_join(F.reverse(F.slice(words, 1, 20)), " "), F.lit(" 12345")))
    )
    told = table.join(following, "id", "left").select("id", F.col("original_text").alias("source"), summary.alias("summary"))
    return told.filter("summary IS NOT NULL")


@query("m16_guards_of_retold", f"WITH {_RETOLD}, {_GUARDS}")
def _(spark, d):
    return summarize.summary_guards(retold(spark, d)).drop("source", "summary")


@query("u2_array_sets", f"""WITH {_PAIRS}, t AS (SELECT id, list_distinct({CONTENT('source')}) AS a,
   list_distinct({CONTENT('summary')}) AS b FROM pairs)
 SELECT id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS both,
 len(list_filter(b, lambda x: NOT list_contains(a, x))) AS missing FROM t""")
def _(spark, d):
    a, b = S.content_tokens(F.col("source")), S.content_tokens(F.col("summary"))
    return pairs(spark, d).select(
        "id", F.size(F.array_intersect(a, b)).cast("bigint").alias("shared"),
        F.size(F.array_union(a, b)).cast("bigint").alias("both"),
        F.size(F.array_except(b, a)).cast("bigint").alias("missing"),
    )


@query("a9_distinct_tokens", f"""SELECT id, len(list_distinct({CONTENT('original_text')})) AS tokens,
 len(list_distinct(regexp_extract_all(original_text, '[0-9]+(?:[.,][0-9]+)?'))) AS numbers FROM posts""")
def _(spark, d):
    numbers = F.regexp_extract_all("original_text", F.lit(S.NUMBER), F.lit(0))
    return posts(spark, d).select(
        "id", F.size(F.array_distinct(S.content_tokens(F.col("original_text")))).cast("bigint").alias("tokens"),
        F.size(F.array_distinct(numbers)).cast("bigint").alias("numbers"),
    )
