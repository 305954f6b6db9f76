"""Language identification by a string kernel.

The kernel of two texts counts the distinct character n-grams (1 to 4) present in both,
divided by the geometric mean of their own counts. Texts are compared with a bounded set of
landmarks (Nyström): kernel ridge regression, one language against the rest, is solved in
the space the landmarks span. Scoring multiplies batches of presence rows by one matrix in
which landmarks and coefficients are already multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from postlens.llm.common import arrow_schema, only, slices, text_or_empty
from postlens.llm.words import mix

#: N-grams are named by hash in a space of this size.
SPACE = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Bounds of the labelled sample that the classifier is fitted on, all languages together.
SAMPLE_ROWS = 2000
LANDMARKS = 300
RIDGE = 1e-3
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point of a letter -> itself, of anything else -> 0."""
    codes = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.array([chr(c).isalpha() for c in range(0x110000)]), codes, 0).astype(np.uint32)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram name) of every distinct n-gram, as a boolean matrix, and whether
    each text has a letter. Case and the kind of non-letters do not count."""
    encoded = [t.lower().encode("utf-32-le", "surrogatepass") + b"\0\0\0\0" for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(e) // 4 for e in encoded])
    codes = _letters()[np.frombuffer(b"".join(encoded), "<u4")]
    first = np.ones(len(codes), bool)
    first[1:] = owner[1:] != owner[:-1]
    inside = (codes != 0) | first
    inside[1:] |= codes[:-1] != 0  # runs of non-letters count as one
    codes, owner = codes[inside].astype(np.uint64), owner[inside]
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[codes != 0]] = True
    matrix = np.zeros((len(texts), SPACE), bool)
    flat, gram = matrix.reshape(-1), np.zeros(len(codes), np.uint64)
    for p in ORDERS:
        n = len(codes) - p + 1
        if n <= 0:
            break
        gram = gram[:n] * np.uint64(0x100000001B3) + codes[p - 1 :] + np.uint64(1)
        same = owner[:n] == owner[p - 1 :]
        name = mix(gram[same] + np.uint64(p)) >> np.uint64(64 - SPACE.bit_length() + 1)
        flat[owner[:n][same] * SPACE + name.astype(np.int64)] = True
    return matrix, has_letter


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SPACE x languages

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts or not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        matrix, has_letter = presence(texts)
        own = np.sqrt(np.maximum(matrix.sum(axis=1), 1))
        values = (matrix.astype(np.float32) @ self.weights) / own[:, None]
        best = values.argmax(axis=1)
        score = np.clip((1 + values[np.arange(len(texts)), best]) / 2, 0, 1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, has_letter)]
        return names, np.where(has_letter, score, 0.0).astype(float)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that training never sees; a null id belongs to the training side."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % 3 == 1


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Fit on a sample of at most ``sample_rows`` labelled rows outside the held-out fold,
    drawn by a hash of id and text, in equal shares for each language."""
    read = only(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in read.groupBy("lang").count().orderBy("lang").collect()}
    if not sizes:
        return Model([], np.zeros((SPACE, 0), np.float32))
    share = max(1, sample_rows // len(sizes))
    draw = F.xxhash64("doc_id", "text").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    # Twice the share is expected below this bound; the smallest draws of it are taken.
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(2.0 * share / n)) for k, n in sizes.items()])
    schema = "lang string, draw double, grams binary"
    out = arrow_schema(schema)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in slices(batches, most=1 << 20):
            matrix, has_letter = presence(run.column("text").to_pylist())
            packed = [np.packbits(m).tobytes() if ok else None for m, ok in zip(matrix, has_letter)]
            yield pa.RecordBatch.from_arrays([run.column("lang"), run.column("draw"), pa.array(packed, pa.binary())], schema=out)

    near = read.withColumn("draw", draw).filter(F.col("draw") < bound)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = near.select("lang", "draw", "text", rank.alias("nth")).filter(F.col("nth") <= share).drop("nth")
    found = drawn.mapInArrow(grams, schema).filter("grams is not null").collect()
    found.sort(key=lambda r: (r["draw"], r["lang"], r["grams"]))
    return fit([r["lang"] for r in found], [r["grams"] for r in found], landmarks)


def fit(langs: list[str], packed: list[bytes], landmarks: int) -> Model:
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((SPACE, 0), np.float32))
    each = max(1, landmarks // len(languages))
    chosen = [i for k in languages for i in [j for j, v in enumerate(langs) if v == k][:each]]

    def rows(index: list[int]) -> np.ndarray:
        m = np.unpackbits(np.frombuffer(b"".join(packed[i] for i in index), np.uint8)).reshape(len(index), SPACE)
        m = m.astype(np.float32)
        return m / np.sqrt(m.sum(axis=1, keepdims=True))

    marks = rows(chosen)
    target = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    balance = 1 / (target > 0).sum(axis=0)[(target > 0).argmax(axis=1)]
    among = (marks @ marks.T).astype(float)
    left, right = np.zeros_like(among), np.zeros((len(chosen), len(languages)))
    for a in range(0, len(packed), 200):
        k = (rows(list(range(a, min(a + 200, len(packed))))) @ marks.T).astype(float)
        w = balance[a : a + 200, None]
        left += k.T @ (k * w)
        right += k.T @ (target[a : a + 200] * w)
    coefficients = np.linalg.solve(left + RIDGE * among + 1e-8 * np.eye(len(chosen)), right)
    return Model(languages, (marks.T @ coefficients).astype(np.float32))


def identify(docs: DataFrame, model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with lang_pred and lang_score appended (under ``_lang_pred`` and
    ``_lang_score`` where those names are taken).

    Null text and text without a letter are ``und`` with score 0, and so is all text where
    there is nothing to learn from. Predictions depend on the text alone, so copies agree;
    ties go to the alphabetically first language. An empty table stays empty.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    names = [n if n not in keep else f"_{n}" for n in ("lang_pred", "lang_score")]
    schema = StructType([*[docs.schema[k] for k in keep], *map(StructField, names, [StringType(), DoubleType()])])
    out = arrow_schema(schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in slices(batches, most=1 << 19):
            for a in range(0, run.num_rows, 128):
                part = run.slice(a, 128)
                found, score = shared.value.score([t or "" for t in part.column("text").to_pylist()])
                columns = [part.column(k).cast(f.type) for k, f in zip(keep, out)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(score)], schema=out)

    return docs.mapInArrow(label, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = train(docs)
    read = only(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), text_or_empty().alias("text"))
    return identify(read, model, ["doc_id", "held_out"]).withColumnRenamed("lang_score", "score")


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without rows of no language. Where ``lang`` is null it becomes the predicted
    language; other columns are unchanged. Where there is nothing to learn from, texts with
    a letter stay as they are."""
    model = train(docs)
    if not model.languages:
        return with_letters(docs)
    found = identify(docs, model)
    predicted = F.col(found.columns[-2])
    return found.filter(predicted != UNKNOWN).withColumn("lang", F.coalesce("lang", predicted)).select(*docs.columns)
