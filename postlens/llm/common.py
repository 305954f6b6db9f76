"""What the corpus operators share: durable intermediate tables and row selection."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.session import shared_dir

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    A table written here is read back without a known partitioning, so joins of two such
    tables may be split by adaptive execution when a key is hot.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete spent tables of this run."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Text without other characters takes the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def kept_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text) is in ``kept`` (doc_id, text_key), each
    such pair once. One shuffle of the documents serves the choice and the semi-join."""
    # A null id has a flag, so that it is no other id's equal whatever the ids' type.
    id_parts = {"_key_none": F.col("doc_id").isNull(), "_key_id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}
    key = [*id_parts, "_key_text"]
    pair = Window.partitionBy(*key).orderBy("_key_id")
    marked = docs.withColumns({**id_parts, "_key_text": text_key()}).withColumn("_copy", F.row_number().over(pair))
    wanted = kept.select(*[c.alias(k) for k, c in id_parts.items()], F.col("text_key").alias("_key_text"))
    return marked.filter("_copy = 1").join(wanted, key, "left_semi").select(*docs.columns)


def text_key(column: str = "text") -> Column:
    """A 256-bit name of the exact text; null counts as empty."""
    return F.sha2(text_or_empty(column), 256)


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, so that other columns never clash with its own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def arrow_schema(ddl) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    return to_arrow_schema(ddl if isinstance(ddl, StructType) else _parse_datatype_string(ddl))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``most`` bytes of text, so that the
    arrays made from a run stay small. A row is never cut."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < len(lengths):
            yield batch.slice(start)
