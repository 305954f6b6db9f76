"""The registered queries of this subpackage, over whole tables, and their SQL twins."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import documents
from postlens.llm.chat_format import format_chats
from postlens.llm.conversation_repair import repair
from postlens.llm.exact_dedup import exact_dedup
from postlens.llm.fingerprints import fingerprints
from postlens.llm.jaccard_join import near_duplicates
from postlens.llm.language_id import predictions
from postlens.llm.lm_scoring import pseudo_likelihood
from postlens.llm.minhash import minhash_duplicates
from postlens.llm.mixing import mix, twin
from postlens.llm.packing import pack
from postlens.llm.pii import personal_data
from postlens.llm.repair_sql import REPAIR
from postlens.llm.substring_dedup import remove_repeats
from postlens.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Workers hand memory back: Arrow takes it from the C library, which maps large arrays one
#: by one, so that an idle worker does not sit on the arrays of its last task.
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20),
    "MALLOC_ARENA_MAX": "2",
}


#: Rows of a batch between the engine and a Python worker, where the session has the default:
#: whole texts travel, so a batch of the default size holds tens of megabytes on either side.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def importable(spark: SparkSession) -> None:
    """Let the Python workers of this session find the package where the driver found it, and
    bound the memory that they take and keep between tasks."""
    name, default, fewer = BATCH_ROWS
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, fewer)
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        environment.setdefault(name, os.environ.get(name, value))
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def register(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@register
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(
        documents(spark, sf_dir), tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=False
    )


@register
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


@register
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)


@register
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(documents(spark, sf_dir))


@register
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).withColumn("probability", F.round("probability", 9))


@register
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


@register
def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(documents(spark, sf_dir))


@register
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_key")


@register
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@register
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


@register
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@register
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@register
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(documents(spark, sf_dir)).drop("text_key")


def similar_sets(width: int, least: int) -> str:
    """CTEs ending in ``labelled`` (doc_id, n_shingles, component_id): word shingles, all
    pairs of different sets that share one, and the reach of their links."""
    words = f"""regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"""
    full = f"[array_to_string(w[i : i + {width - 1}], ' ') for i in range(1, len(w) - {width - 2})]"
    return f"""
        docs AS (SELECT doc_id, {words} AS w FROM documents),
        sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {width} THEN {full}
          WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END)) AS s FROM docs),
        names AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM sets GROUP BY s),
        held AS (SELECT id, n, unnest(s) AS t FROM names),
        links AS (SELECT a.id AS a, b.id AS b FROM held a JOIN held b ON a.t = b.t AND a.id <> b.id
          GROUP BY a.id, b.id HAVING 100 * count(*) >= {least} * (min(a.n) + min(b.n) - count(*))),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        labelled AS (SELECT d.doc_id, len(d.s) AS n_shingles,
          CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE least(n.id, coalesce(l.b, n.id)) END AS component_id
          FROM sets d JOIN names n ON d.s = n.s LEFT JOIN least l ON l.a = n.id)"""


ORACLES: dict[str, str] = {
    "op5_mixing": f"""
        WITH {twin("documents")}
        SELECT doc_id, source, lang, topic, tokens, round(probability, 9) AS probability, u < probability AS selected FROM drawn""",
    "op10_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
          count(*) OVER (PARTITION BY t) AS group_size,
          doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op8_jaccard_join": f"""
        WITH RECURSIVE {similar_sets(5, 75)}
        SELECT doc_id, n_shingles, component_id FROM labelled""",
    "op12_conversation_repair": REPAIR,
    "op13_minhash": f"""
        WITH RECURSIVE {similar_sets(3, 85)}
        SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM labelled""",
}
