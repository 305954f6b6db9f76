"""Removal of repeated passages, with a count-min sketch before the exact grouping.

A window is a run of consecutive words of one document. Each window has an anchor: of the
word n-grams inside it the one with the smallest hash. Equal windows have equal anchors, so
no window is in more documents than its anchor, and what a sketch says of the anchor is an
overestimate for the window. Pass one counts anchors, once per document, in a sketch per
partition; the sketches are merged stripe by stripe. Pass two hashes exactly the windows
whose anchor may be in two documents and groups them; none is lost, and the windows that
came through by accident form groups of one.

Before the shuffle the windows of one run of documents are grouped among themselves: only
those of the smallest doc_id travel, so a passage that a third of all documents share makes
one entry per run of rows, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Scratch, arrow_schema, only, shuffle_partitions, slices, text_or_empty
from postlens.llm.words import Words, mix, planes, unplanes

WINDOW = 50
#: Words of an anchor.
GRAM = 18
#: Rows of the sketch, cells per expected anchor, and the bounds of a row's size. Beyond the
#: upper bound (about 0.2 TB of text) more windows pass to the exact grouping; none is lost.
DEPTH = 3
CELLS = 4
LEAST_BITS, MOST_BITS = 16, 28

_LAST = np.iinfo(np.int64).max
_BASES = (0x2545F4914F6CDD1D, 0xDA942042E4DD58B5, 0x9E6C63D0676A9A99)


def _anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: the anchor of the window that starts there, and its text (-1: none)."""
    owner = np.repeat(np.arange(len(words)), words.counts())
    n = len(owner) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, _ = words.shingles(gram, _BASES[0])
    least, span, want = grams, 1, window - gram + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return least[:n], np.where(owner[:n] == owner[window - 1 :], owner[:n], -1)


def _runs(anchor: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where a new anchor or text begins."""
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    return new


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(anchor + np.uint64(_BASES[1] * (row + 1) % (1 << 64))) >> np.uint64(64 - bits)


def sketch_bits(docs: DataFrame, window: int, gram: int) -> int:
    """log2 of a row's cells, from the bytes of all texts: about 6 bytes a word, and two
    anchors in as many words as a window has n-grams and one."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = size / 6 * 2 / (window - gram + 2)
    return min(MOST_BITS, max(LEAST_BITS, int(CELLS * expected).bit_length()))


def repeated_cells(docs: DataFrame, window: int, gram: int, bits: int) -> list[np.ndarray]:
    """For each row of the merged sketch, one bit per cell: counted twice or more."""
    stripe_bits = max(0, min(bits - 12, (shuffle_partitions(docs.sparkSession) // DEPTH).bit_length()))
    schema = "stripe int, cells binary, again binary"
    out = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for run in slices(batches):
            anchor, owner = _anchors(Words(run.column("text")), window, gram)
            new = _runs(anchor, owner) & (owner >= 0)
            anchor, owner = anchor[new], owner[new]
            order = np.lexsort((anchor, owner))
            once = _runs(anchor[order], owner[order])
            seen.append(anchor[order][once])
        anchor = np.concatenate(seen) if seen else np.zeros(0, np.uint64)
        for row in range(DEPTH):
            cells, n = np.unique(_cells(anchor, row, bits), return_counts=True)
            stripe = (cells >> np.uint64(bits - stripe_bits)).astype(np.int64)
            cut = np.searchsorted(stripe, np.arange((1 << stripe_bits) + 1))
            for k in np.flatnonzero(np.diff(cut)):
                part = slice(cut[k], cut[k + 1])
                within = (cells[part] & np.uint64((1 << (bits - stripe_bits)) - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row << stripe_bits | int(k)], pa.int32()),
                     pa.array([planes(np.diff(within, prepend=np.uint32(0)))], pa.binary()),
                     pa.array([np.packbits(n[part] > 1).tobytes()], pa.binary())],
                    schema=out,
                )

    def merge(table: pa.Table) -> pa.Table:
        size = 1 << (bits - stripe_bits)
        once, again = np.zeros(size, bool), np.zeros(size, bool)
        for cells, twice in zip(table.column("cells"), table.column("again")):
            at = np.cumsum(unplanes(cells.as_py(), np.uint32), dtype=np.uint32)
            flags = np.unpackbits(np.frombuffer(twice.as_py(), np.uint8), count=len(at)).astype(bool)
            again[at] |= once[at] | flags
            once[at] = True
        stripe = table.column("stripe")[0].as_py()
        return pa.table({"stripe": pa.array([stripe], pa.int32()), "bits": pa.array([np.packbits(again).tobytes()], pa.binary())})

    striped = docs.select("text").mapInArrow(count, schema)
    merged = striped.groupBy("stripe").applyInArrow(merge, "stripe int, bits binary")
    size = 1 << (bits - stripe_bits)
    rows = [np.zeros((1 << stripe_bits, size // 8), np.uint8) for _ in range(DEPTH)]
    for r in merged.collect():  # one bit a cell: DEPTH * 2 ** bits bits in all
        rows[r["stripe"] >> stripe_bits][r["stripe"] & ((1 << stripe_bits) - 1)] = np.frombuffer(r["bits"], np.uint8)
    return [r.reshape(-1) for r in rows]


def _by_document(doc: np.ndarray, key: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(document, text key, positions) of sorted-out entries."""
    order = np.lexsort((pos, key, doc))
    doc, key, pos = doc[order], key[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    for a, b in zip(starts, [*starts[1:], len(doc)]):
        yield int(doc[a]), int(key[a]), pos[a:b].astype("<i4").tobytes()


def repeated_windows(docs: DataFrame, cells: list[np.ndarray], window: int, gram: int, bits: int) -> DataFrame:
    """doc, text_hash, pos: the first words, as little-endian numbers, of windows that also
    start in a document with a smaller doc_id. A document may have several rows."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    buckets = shuffle_partitions(docs.sparkSession)
    schema = "bucket int, doc bigint, text_hash bigint, pos binary, h1 binary, h2 binary, docs binary, hashes binary"
    out = arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for run in slices(batches, most=2 << 20):
            words = Words(run.column("text"))
            anchor, owner = _anchors(words, window, gram)
            new = _runs(anchor, owner)
            maybe = owner[new] >= 0
            for row in range(DEPTH):
                cell = _cells(anchor[new], row, bits)
                maybe &= (sketch[row][(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(maybe[np.cumsum(new) - 1] if len(new) else new)
            if not len(at):
                continue
            h1 = words.shingles(window, _BASES[1])[0][at]
            h2 = (words.shingles(window, _BASES[2])[0][at] >> np.uint64(32)).astype(np.uint32)
            text = owner[at]
            doc = run.column("doc").to_numpy()[text]
            key = run.column("text_hash").to_numpy()[text]
            pos = (at - words.first[text]).astype(np.int32)
            order = np.lexsort((doc, h2, h1))
            first = np.ones(len(at), bool)
            first[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            least = doc[order][np.flatnonzero(first)][np.cumsum(first) - 1]
            later = np.zeros(len(at), bool)
            later[order] = doc[order] > least
            rows = [(int(d % buckets), d, k, p, None, None, None, None) for d, k, p in _by_document(doc[later], key[later], pos[later])]
            # Equal windows have equal anchors, and neighbours mostly the same one.
            bucket = (mix(anchor[at]) % np.uint64(buckets)).astype(np.int64)
            h1, h2, doc, key, pos, bucket = (x[~later] for x in (h1, h2, doc, key, pos, bucket))
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cut)):
                part = order[cut[k] : cut[k + 1]]
                rows.append((int(k), None, None, planes(pos[part]), planes(h1[part]), planes(h2[part]), planes(doc[part]), planes(key[part])))
            if rows:
                yield batch(rows)

    def settle(table: pa.Table) -> pa.Table:
        done = [(d, k, p) for d, k, p, h in zip(*(table.column(c).to_pylist() for c in ("doc", "text_hash", "pos", "h1"))) if h is None]
        sent = table.filter(pc.is_valid(table.column("h1")))
        if sent.num_rows:
            read = lambda c, kind: np.concatenate([unplanes(x, kind) for x in sent.column(c).to_pylist()])
            h1, h2 = read("h1", np.uint64), read("h2", np.uint32)
            doc, key, pos = read("docs", np.int64), read("hashes", np.int64), read("pos", np.int32)
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc, key, pos = (x[order] for x in (h1, h2, doc, key, pos))
            first = np.ones(len(h1), bool)
            first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            later = doc > doc[first][np.cumsum(first) - 1]
            done += _by_document(doc[later], key[later], pos[later])
        columns = list(zip(*done)) or [[], [], []]
        return pa.table({
            "doc": pa.array(columns[0], pa.int64()), "text_hash": pa.array(columns[1], pa.int64()), "pos": pa.array(columns[2], pa.binary()),
        })

    found = docs.mapInArrow(candidates, schema)
    return found.groupBy("bucket").applyInArrow(settle, "doc bigint, text_hash bigint, pos binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, with
    ``with_text``, kept_text (the kept words joined by one space).

    A word goes if a window that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input. Null text has no words. A null doc_id is larger than any
    other. Rows with the same doc_id are one document to each other: none removes another's
    words. Texts with fewer words than a window stay whole. Other columns are not read.
    Windows are told apart by 96 bits of two polynomial hashes. doc_id must be a number, or
    text of one.
    """
    read = only(docs, "doc_id", "text").select(
        "doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"),
    )
    bits = sketch_bits(read, window, gram)
    cells = repeated_cells(read, window, gram, bits)
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    windows = scratch.table(
        repeated_windows(read.select("doc", "text_hash", "text"), cells, window, gram, bits), "windows"
    )
    per_text = windows.groupBy("doc", "text_hash").agg(F.collect_list("pos").alias("pos"))
    joined = read.join(per_text, ["doc", "text_hash"], "left").select("doc_id", "text", "pos")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_removed bigint, kept_sha256 string" + (
        ", kept_text string" if with_text else ""
    )
    out = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in slices(batches, most=2 << 20):
            rows = []
            for text, starts in zip(run.column("text").to_pylist(), run.column("pos").to_pylist()):
                words = text.encode().split()
                n, gone = len(words), 0
                if starts:
                    steps = np.zeros(n + 1, np.int64)
                    at = np.unique(np.frombuffer(b"".join(starts), "<i4"))
                    steps[at] += 1
                    steps[at + window] -= 1
                    stay = np.cumsum(steps[:n]) == 0
                    gone = n - int(stay.sum())
                    words = list(compress(words, stay.tolist()))
                kept = b" ".join(words)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            columns = [run.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(out)[1:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return joined.mapInArrow(cut, schema)
