"""Translation requests made from the posts view: routing, cache, chunks, translators."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import language_id
from postlens.operators import translate as T
from postlens.plans.fixture import posts
from postlens.plans.registry import query
from postlens.plans.text_queries import U16, docs, q, rep, sql_ranked, sql_trigram_counts, sql_trim

# every post asks for one translation; stated languages and targets cover all routes
REQUESTS = """SELECT id, original_text AS text, tr_hindi, tr_english,
 CASE id % 7 WHEN 0 THEN language WHEN 1 THEN ' EN' WHEN 2 THEN 'por' WHEN 3 THEN 'und'
   WHEN 4 THEN 'Punjabi' WHEN 5 THEN 'zho' ELSE 'no language' END AS source_language,
 CASE id % 5 WHEN 0 THEN 'english' WHEN 1 THEN 'Hindi' WHEN 2 THEN 'PUNJABI' WHEN 3 THEN 'german'
   ELSE 'latin' END AS target_language FROM posts"""
MANY = ["ita", "lat", "nld", "pol", "por", "ukr"]  # codes the given table of this query holds


def _requests(spark, d):
    made = REQUESTS.replace("tr_hindi, tr_english", "translations").replace("FROM posts", "FROM {p}")
    return spark.sql(made, p=posts(spark, d))


def _many(spark):
    return spark.createDataFrame([(c,) for c in MANY], "code string")


def _case(table, key):
    arms = " ".join(f"WHEN {q(k)} THEN {q(v) if v else 'NULL'}" for k, v in table.items())
    return f"CASE {key} {arms} END"


_LANG = "lower(" + sql_trim("source_language") + ")"
_ALIASED = f"{_LANG} IN ({', '.join(q(a) for a in T.ALIASES)})"
DIRECT = f"""CASE WHEN {_ALIASED} THEN {_case(T.ALIASES, _LANG)}
 WHEN {_LANG} IN ({', '.join(q(m) for m in T.MODELS)}) THEN {_LANG} END"""
RAW = f"""CASE WHEN {_ALIASED} THEN {_case(T.ALIASES, _LANG)} WHEN regexp_full_match({_LANG}, '[a-z]{{2,3}}') THEN {_LANG} END"""


@query("tr1_targets", f"""WITH t(target, code) AS (VALUES {", ".join(f"({q(n)}, {q(c[0])})" for n, c in T.TARGETS.items())})
 SELECT target, code, count(posts.id) AS posts FROM t LEFT JOIN posts ON language = code GROUP BY ALL""")
def _(spark, d):
    spoken = posts(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("posts"))
    joined = T.targets(spark).join(spoken, F.col("language") == F.col("code"), "left")
    return joined.select("target", "code", F.coalesce("posts", F.lit(0)).alias("posts"))


@query("tr2_normalize_source", f"WITH r AS ({REQUESTS}) SELECT id, {DIRECT} AS source FROM r")
def _(spark, d):
    return _requests(spark, d).select("id", T.normalize_source(F.col("source_language")).alias("source"))


_IN_MANY = f"IN ({', '.join(q(m) for m in MANY)})"


@query("tr3_raw_source", f"""WITH r AS ({REQUESTS}), s AS (SELECT id, {DIRECT} AS direct, {RAW} AS raw FROM r)
 SELECT id, coalesce(direct, CASE WHEN raw {_IN_MANY} THEN raw END) AS source_code,
 CASE WHEN direct IS NOT NULL THEN false WHEN raw {_IN_MANY} THEN true END AS via_many FROM s""")
def _(spark, d):
    out = T.with_source(_requests(spark, d), _many(spark))
    return out.select("id", "source_code", "via_many")


def _detected(spark, d):
    profiles = language_id.train_profiles(docs(spark, d))
    ranked = language_id.rank_languages(posts(spark, d), profiles, ["id"], F.col("original_text"))
    return T.first_supported(ranked, ["id"], _many(spark))


_DETECTED = f"""p AS {sql_ranked(sql_trigram_counts("documents", "lang", "text"), "lang")},
 o AS {sql_ranked(sql_trigram_counts(f"(SELECT id, original_text AS body FROM posts WHERE {U16('original_text')} >= 10)", "id", "body"), "id")},
 oz AS (SELECT id, count(*) AS size FROM o GROUP BY ALL),
 os AS (SELECT o.id, p.lang, sum(300 - abs(o.rank - p.rank)) AS saved FROM o JOIN p USING (tri) GROUP BY ALL),
 od AS (SELECT id, size * 300 - saved AS distance, lang AS source_language FROM os JOIN oz USING (id)),
 ou AS (SELECT id, distance, source_language AS lang, {DIRECT} AS direct FROM od),
 detected AS (SELECT id, coalesce(direct, lang) AS detected, direct IS NULL AS detected_via_many FROM ou
   WHERE direct IS NOT NULL OR lang {_IN_MANY} QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, lang) = 1)"""


@query("tr4_detected_source", f"WITH {_DETECTED} SELECT * FROM detected")
def _(spark, d):
    return _detected(spark, d)


def _routes_sql(mode, detect=False):
    """Requests up to their route, as the table ``m``."""
    remote = "true" if mode == "remote" else "false"
    suffix = {k: v[1] for k, v in T.TARGETS.items()}
    code = {k: v[0] for k, v in T.TARGETS.items()}
    guess, found = ("code", "many") if detect else ("NULL", "false")
    joined = "LEFT JOIN (SELECT id, detected AS code, detected_via_many AS many FROM detected) USING (id)" if detect else ""
    return f"""{_DETECTED + ',' if detect else ''} r AS ({REQUESTS}), s AS (SELECT *, {DIRECT} AS direct, {RAW} AS raw,
   lower({sql_trim('target_language')}) AS t,
   CASE lower(target_language) WHEN 'hindi' THEN tr_hindi WHEN 'english' THEN tr_english END AS cached FROM r),
 c AS MATERIALIZED (SELECT s.*, coalesce(direct, CASE WHEN raw {_IN_MANY} THEN raw END, {guess}) AS code,
   direct IS NULL AND (coalesce(raw {_IN_MANY}, false) OR coalesce({found}, false)) AS many FROM s {joined}),
 x AS MATERIALIZED (SELECT *, {_case(suffix, 't')} AS dst, {_case(code, 't')} AS dst_code,
   CASE WHEN NOT many THEN {_case(T.MODELS, 'code')} END AS src FROM c),
 e AS MATERIALIZED (SELECT *, CASE WHEN cached IS NOT NULL THEN NULL WHEN dst IS NULL THEN 'unsupported_target'
   WHEN code IS NULL THEN 'unsupported_source' WHEN coalesce(src = dst, false) THEN NULL
   WHEN {remote} AND many THEN 'remote_unsupported_source'
   WHEN NOT {remote} AND many AND dst = 'pa' THEN 'no_route_to_punjabi' END AS error FROM x),
 m AS MATERIALIZED (SELECT *, CASE WHEN cached IS NOT NULL THEN 'cached' WHEN error IS NOT NULL THEN NULL
   WHEN coalesce(src = dst, false) THEN 'no_translation_needed' WHEN {remote} THEN 'remote_mymemory'
   WHEN many AND dst = 'en' THEN 'local_model_fallback_multilingual'
   WHEN many THEN 'local_model_fallback_multilingual_pivot_via_english'
   WHEN src = 'pa' OR dst = 'pa' THEN 'remote_libretranslate'
   WHEN src = 'en' OR dst = 'en' THEN 'local_model' ELSE 'local_model_pivot_via_english' END AS method FROM e)"""


def _plan_sql(mode):
    return f"""WITH {_routes_sql(mode)}
 SELECT id, method, error, CASE WHEN method <> 'no_translation_needed' AND length(text) > 512
   AND (cached IS NULL OR cached <> text) THEN 512 END::INTEGER AS truncated_at,
 CASE WHEN method = 'remote_mymemory' THEN {_case(T.REMOTE_CODES, 'code')} END AS remote_source,
 CASE WHEN method = 'remote_mymemory' THEN {_case(T.REMOTE_CODES, 'dst_code')} END AS remote_target FROM m"""


def _planned(spark, d, mode, max_chars=None):
    return T.translation_plan(T.with_source(_requests(spark, d), _many(spark)), mode, max_chars)


def _plan_query(mode):
    name = "tr5_translation_plan" if mode == "local" else "tr5_translation_plan_remote"

    @query(name, _plan_sql(mode))
    def run(spark, d):
        return _planned(spark, d, mode, T.MAX_CHARS).select(
            "id", "method", "error", "truncated_at", "remote_source", "remote_target"
        )


_plan_query("local")
_plan_query("remote")


@query("tr5_translation_plan_detected", f"""WITH {_routes_sql("local", detect=True)}
 SELECT id, code AS source_code, method, error FROM m""")
def _(spark, d):
    sourced = T.with_source(_requests(spark, d), _many(spark), _detected(spark, d))
    return T.translation_plan(sourced).select("id", "source_code", "method", "error")


@query("tr6_truncate", """SELECT doc_id, substr(text, 1, 512) AS given,
 CASE WHEN length(text) > 512 THEN 512 END AS truncated_at FROM documents""", with_posts=False)
def _(spark, d):
    cut = T.truncate(F.col("text")).alias("c")
    return docs(spark, d).select("doc_id", cut).select("doc_id", F.col("c.text").alias("given"), "c.truncated_at")


def _chunks_sql(source, key, limit, whole):
    """Tables up to ``chunks(key, part, chunk)`` of ``source(key, t)``; texts that are
    ``whole`` stay uncut, the others are filled sentence by sentence."""
    bytes_of = lambda e: f"octet_length(encode({e}))"
    fits = f"NOT fresh AND {bytes_of("open || ' ' || piece")} <= {limit}"
    ends = rep("t", r"([.!?\n])\s+", r"\1" + chr(1))
    return f"""given AS MATERIALIZED (SELECT {key}, t, {whole} AS whole FROM {source}),
 se AS MATERIALIZED (SELECT {key}, unnest(l) AS s, generate_subscripts(l, 1) AS j FROM (SELECT {key},
   list_filter(string_split({ends}, chr(1)), lambda x: x <> '') AS l FROM given WHERE NOT whole)),
 cu AS (SELECT {key}, j, 0 AS k, '' AS piece, s AS rest FROM se WHERE {bytes_of('s')} > {limit}
   UNION ALL SELECT {key}, j, k + 1, substr(rest, 1, n), substr(rest, n + 1) FROM (SELECT *, list_max(list_filter(
     range(1, {limit + 1}), lambda m: {bytes_of('substr(rest, 1, m)')} <= {limit})) AS n FROM cu WHERE rest <> '')),
 pi AS MATERIALIZED (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY j, k) AS i, piece, fresh FROM (
   SELECT {key}, j, 0 AS k, s AS piece, false AS fresh FROM se WHERE {bytes_of('s')} <= {limit}
   UNION ALL SELECT {key}, j, k, piece, true FROM cu WHERE k > 0)),
 fo AS (SELECT {key}, i, 0 AS part, piece AS open FROM pi WHERE i = 1
   UNION ALL SELECT pi.{key}, pi.i, CASE WHEN {fits} THEN part ELSE part + 1 END,
     CASE WHEN {fits} THEN open || ' ' || piece ELSE piece END
   FROM fo JOIN pi ON pi.{key} = fo.{key} AND pi.i = fo.i + 1),
 chunks AS (SELECT {key}, part, arg_max(open, i) AS chunk FROM fo GROUP BY ALL
   UNION ALL SELECT {key}, 0, t FROM given WHERE whole)"""


_DOC_CHUNKS = "WITH RECURSIVE " + _chunks_sql(
    "(SELECT doc_id, text AS t FROM documents)", "doc_id", T.CHUNK_BYTES, f"octet_length(encode(t)) <= {T.CHUNK_BYTES}"
)


@query("tr7_chunks", f"{_DOC_CHUNKS} SELECT doc_id, part, chunk FROM chunks", with_posts=False)
def _(spark, d):
    return T.explode_chunks(docs(spark, d), ["doc_id"])


@query("tr7_join_chunks", f"""{_DOC_CHUNKS}
 SELECT doc_id, string_agg(chunk, ' ' ORDER BY part) AS text FROM chunks GROUP BY doc_id""", with_posts=False)
def _(spark, d):
    return T.join_chunks(T.explode_chunks(docs(spark, d), ["doc_id"]), ["doc_id"])


@query("tr8_cached", f"""WITH r AS ({REQUESTS}) SELECT id, CASE lower(target_language) WHEN 'hindi' THEN tr_hindi
 WHEN 'english' THEN tr_english END AS cached FROM r""")
def _(spark, d):
    cached = T.cached_translation(F.col("translations"), F.col("target_language"))
    return _requests(spark, d).select("id", cached.alias("cached"))


def _upper(texts, source, target):
    return [f"[{source}>{target}] {t.upper()}" for t in texts]


def _translate_sql(mode):
    """Whole texts in pieces through a stand-in for a model that says routes and capitals."""
    remote = mode == "remote"
    limit, whole = (T.CHUNK_BYTES, f"octet_length(encode(t)) <= {T.CHUNK_BYTES}") if remote else (
        T.MAX_CHARS, f"{U16('t')} <= {T.MAX_CHARS}")
    said = lambda a, b, e: f"'[' || {a} || '>' || {b} || '] ' || upper(replace({e}, 'ß', 'SS'))"
    once, twice = said("a", "b", "chunk"), said("'en'", "b", said("a", "'en'", "chunk"))
    a = _case(T.REMOTE_CODES, "code") if remote else "coalesce(src, code)"
    b = _case(T.REMOTE_CODES, "dst_code") if remote else "dst"
    return f"""WITH {_routes_sql(mode)},
 wk AS MATERIALIZED (SELECT id, text AS t, method, {a} AS a, {b} AS b FROM m WHERE method SIMILAR TO '(local_model|remote).*'),
 {_chunks_sql("wk", "id", limit, whole)}
 SELECT id, string_agg(CASE WHEN contains(method, 'pivot') THEN {twice} ELSE {once} END, ' ' ORDER BY part) AS translated,
   method, NULL::VARCHAR AS error, NULL::INTEGER AS truncated_at FROM wk JOIN chunks USING (id) GROUP BY id, method
 UNION ALL SELECT id, CASE method WHEN 'cached' THEN cached WHEN 'no_translation_needed' THEN text END, method, error, NULL
 FROM m WHERE coalesce(method IN ('cached', 'no_translation_needed'), true)"""


@query("tr9_translate", _translate_sql("local"))
def _(spark, d):
    return T.translate(_planned(spark, d, "local"), ["id"], _upper)


@query("tr9_translate_remote", _translate_sql("remote"))
def _(spark, d):
    return T.translate(_planned(spark, d, "remote"), ["id"], _upper)


# a phrase table made from the corpus: the longest word of every text, said backwards
@query("tr9_phrase_table", """WITH w AS (SELECT lang, unnest(regexp_split_to_array(text, '[\\t-\\r ]+')) AS word FROM documents),
 p AS (SELECT DISTINCT lang, word FROM w WHERE length(word) > 8),
 s AS (SELECT doc_id, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
   FROM (SELECT doc_id, lang, regexp_split_to_array(text, '[\\t-\\r ]+') AS ws FROM documents))
 SELECT doc_id, string_agg(CASE WHEN p.word IS NULL THEN s.word ELSE reverse(s.word) END, ' ' ORDER BY i) AS translated
 FROM s LEFT JOIN p ON p.word = s.word AND p.lang = s.lang GROUP BY doc_id""", with_posts=False)
def _(spark, d):
    rows = docs(spark, d).select("doc_id", "text", F.col("lang").alias("source"), F.lit("en").alias("target"))
    words = rows.select("source", "target", F.explode(F.split("text", "[\t-\r ]+")).alias("word"))
    phrases = words.filter(F.length("word") > 8).distinct().withColumn("said", F.reverse("word"))
    return T.translate_by_table(rows, phrases, ["doc_id"])
