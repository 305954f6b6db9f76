"""From raw documents to packed training sequences.

Each stage reads what the stage before it kept and returns the columns of documents; the
last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from postlens.llm.common import Scratch, documents
from postlens.llm.exact_dedup import drop_copies
from postlens.llm.jaccard_join import drop_near_copies
from postlens.llm.language_id import drop_unidentified
from postlens.llm.mixing import draw_mixture
from postlens.llm.packing import pack
from postlens.llm.queries import importable, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go; rows without a language get the predicted one."""
    importable(spark)
    return drop_unidentified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row with the smallest doc_id stays."""
    importable(spark)
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are drawn so that sources, languages and topics meet their target shares."""
    return draw_mixture(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every row left, in sequences of 2048."""
    importable(spark)
    return pack(docs, tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=False)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("near copies", near_copies),
    ("mixing", mixture),
    ("packing", packed),
]

#: SQL has no byte-level tokenizer and no learned classifier; tests use a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")

    def step(docs: DataFrame, stage) -> DataFrame:
        name, fn = stage
        out = fn(spark, docs, sf_dir)
        return out if fn is packed else scratch.table(out, name.replace(" ", "-"))

    return reduce(step, STAGES, documents(spark, sf_dir))
