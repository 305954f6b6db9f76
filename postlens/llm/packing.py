"""Packing by concatenate and cut.

All documents form one long row of tokens, each document followed by an end token. Pass one
tokenises and gives each document its place within its partition; prefix sums over the
partitions' totals turn that into a global offset. Pass two cuts the row into windows of
fixed length; a document that crosses a window's edge gets one boundary record, a piece, on
either side. Only the last window has padding.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.llm.common import Scratch, arrow_schema, only, slices, text_or_empty

LENGTH = 2048
END_ID = 1
_COMMON = re.compile(r"[\n\x20-\x7e\xa1-\u024f]*")
#: The second library's pattern recurses over a run of blanks, and it merges a run of other
#: characters in quadratic time.
LONGEST_RUN = 1000
_BLANKS = re.compile(rf"\s{{{LONGEST_RUN}}}")
#: Characters the first library reads at once: it keeps some 150 bytes a token meanwhile.
_AT_ONCE = 1 << 18


class TextTokenizer:
    """Byte-level BPE of whole texts by the tokenizer of ``path``.

    With ``ranks``, the same vocabulary as a ranks file, texts of common Latin characters
    are merged by a second library, which agrees on them and is several times faster. Texts
    with a very long run of blanks or of other characters are left to the first.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.inner.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.merge = _merger(ranks) if ranks else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``dtype``."""
        fast = [self._is_common(t) for t in texts]
        slow = self._slow([t for t, f in zip(texts, fast) if not f])
        return [np.array(self.merge(t), self.dtype).tobytes() if f else next(slow) for t, f in zip(texts, fast)]

    def _slow(self, texts: list[str]) -> Iterator[bytes]:
        group, size = [], 0
        for k, text in enumerate(texts):
            group.append(text)
            size += len(text)
            if size >= _AT_ONCE or k == len(texts) - 1:
                found = self.inner.encode_batch(group, add_special_tokens=False)
                yield from (np.array(e.ids, self.dtype).tobytes() for e in found)
                group, size = [], 0

    def _is_common(self, text: str) -> bool:
        if not (self.merge and _COMMON.fullmatch(text)) or any(t in text for t in self.special):
            return False
        if len(text) <= LONGEST_RUN:
            return True
        sizes = [len(w) for w in text.split()]
        # Blanks beyond one a word: only where there are many may a run of them be long.
        spare = len(text) - sum(sizes) - len(sizes)
        return max(sizes, default=0) <= LONGEST_RUN and (spare < LONGEST_RUN - 1 or not _BLANKS.search(text))


def _merger(ranks: str) -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
    ).encode_ordinary


@lru_cache(maxsize=2)
def tokenizer(path: str, ranks: str | None = None) -> TextTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextTokenizer(path, ranks)


def token_rows(docs: DataFrame, path: str, ranks: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian numbers, the end token included), n, pid, local_start."""
    read = only(docs, "doc_id", "text").withColumn("text", text_or_empty())
    id_type = dict(read.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, ids binary, n bigint, pid int, local_start bigint"
    out = arrow_schema(schema)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, ranks)
        end, width = np.asarray([end_id], t.dtype).tobytes(), np.dtype(t.dtype).itemsize
        pid, place = TaskContext.get().partitionId(), 0
        for run in slices(batches, most=4 << 20):
            ids = [x + end for x in t.encode(run.column("text").to_pylist())]
            n = np.array([len(x) // width for x in ids], np.int64)
            starts = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [run.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n),
                 pa.array(np.full(len(ids), pid, np.int32)), pa.array(starts)],
                schema=out,
            )

    return read.mapInArrow(tokenise, schema)


def pack(
    docs: DataFrame, path: str, ranks: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, with ``with_ids``, ids.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's. Each id
    lies in one piece. Null text counts as empty and yields its end token. Repeated rows and
    null doc_ids are documents of their own. An empty table gives no pieces; columns other
    than doc_id and text are not read. Documents are in the order in which they are read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.table(token_rows(docs, path, ranks, end_id), "tokens")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the first pass, not per document.
    totals = rows.groupBy("pid").agg(F.sum("n").alias("total"))
    offsets = scratch.table(
        totals.select("pid", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("partition_start")), "offsets"
    )
    placed = rows.join(offsets, "pid").select(
        "doc_id", "ids", "n", (F.col("partition_start") + F.col("local_start")).alias("place")
    )
    id_type = dict(docs.dtypes)["doc_id"]
    schema = (
        f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else "")
    )
    out = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = tokenizer(path, ranks).dtype
        for run in slices(batches, "ids", 4 << 20):
            place, n = run.column("place").to_numpy(), run.column("n").to_numpy()
            pieces = (place + n - 1) // length - place // length + 1
            owner = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(place[owner], (place[owner] // length + nth) * length)
            stop = np.minimum(place[owner] + n[owner], (begin // length + 1) * length)
            ids = np.frombuffer(b"".join(run.column("ids").to_pylist()), dtype).astype("<u4")
            at = (np.cumsum(n) - n)[owner] + begin - place[owner]
            spans = [ids[a : a + k] for a, k in zip(at.tolist(), (stop - begin).tolist())]
            columns = [
                run.column("doc_id").take(pa.array(owner)), pa.array(begin - place[owner]), pa.array(stop - begin),
                pa.array([zlib.crc32(s.tobytes()) for s in spans], pa.int64()), pa.array(n[owner]),
                pa.array(begin // length), pa.array(begin % length),
            ]
            if with_ids:
                columns.append(pa.array([s.astype(np.int32) for s in spans], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids, n_tokens: the pieces joined and padded to ``length``; a sequence
    whose length is a power of two stays as it is. A group holds ``length`` ids at most."""
    n = F.col("n_tokens")
    joined = pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"),
        F.sum("length").alias("n_tokens"),
    )
    power = n.bitwiseAND(n - 1) == 0
    padding = F.array_repeat(F.lit(pad_id), (F.lit(length) - n).cast("int"))
    return joined.withColumn("ids", F.when(power, F.col("ids")).otherwise(F.concat("ids", padding)))
