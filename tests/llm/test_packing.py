"""Packing: an exact round trip."""

import zlib

import numpy as np

from postlens.llm.packing import TextTokenizer, pack, sequences
from postlens.llm.queries import tokenizer_path


def plain_ids(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids + [1] for e in found]


def check(docs, rows, length):
    pieces = pack(docs, tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"), length=length)
    got = sorted((r.asDict() for r in pieces.collect()), key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in got:  # gapless, in sequences of full length but the last
        assert r["sequence_id"] * length + r["offset"] == at
        assert r["length"] == len(r["ids"]) > 0 and r["offset"] + r["length"] <= length
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["length"]
    back, left = [], 0
    for r in got:
        if r["start"] == 0:
            back.append((r["doc_id"], []))
        assert len(back[-1][1]) == r["start"]
        back[-1][1].extend(r["ids"])
        assert r["doc_tokens"] >= len(back[-1][1])
    want = list(zip([i for i, _ in rows], plain_ids([t for _, t in rows])))
    assert sorted(back, key=str) == sorted(want, key=str)
    return pieces


def test_round_trip_of_documents(docs, texts):
    check(docs, texts, 2048)


def test_round_trip_of_odd_rows(table, odd_rows):
    rows = [*odd_rows, (30, "<|endoftext|> a  b \n c d"), (31, "  ")]
    check(table(rows), rows, 16)


def test_no_rows(table):
    assert pack(table([]), tokenizer_path()).count() == 0


def test_sequences_are_padded_but_for_powers_of_two(table):
    pieces = check(table([(1, "a b c d e f g h i j")]), [(1, "a b c d e f g h i j")], 8)
    got = {r["sequence_id"]: r for r in sequences(pieces, 8, pad_id=0).collect()}
    assert [len(got[k]["ids"]) for k in sorted(got)] == [8, 8] and got[1]["ids"][3:] == [0] * 5
    pieces = pack(table([(1, "a b c")]), tokenizer_path(), length=8)
    assert [len(r["ids"]) for r in sequences(pieces, 8).collect()] == [4]


def test_both_libraries_agree():
    import random

    rng = random.Random(5)
    parts = ["a", "the", "Zu", " ", "  ", "\n", " \n", "\t", "'s", "1", "23", ".", ",", "é", "ñ", " ", "漢", "😀", "<|endoftext|>", "́"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)]
    both = TextTokenizer(tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))
    assert [np.frombuffer(x, both.dtype).tolist() + [1] for x in both.encode(texts)] == plain_ids(texts)


def test_very_long_runs_of_one_kind_of_character(table):
    rows = [(i, c * 2_000_000) for i, c in enumerate((" ", "a", "1", "\n", "!"))] + [(9, "ordinary words")]
    pieces = pack(table(rows), tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"), length=1 << 16, with_ids=False).collect()
    for i, ids in zip([i for i, _ in rows], plain_ids([t for _, t in rows])):
        mine = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == mine[0]["doc_tokens"] == len(ids)
        whole = np.array(ids, "<u4")
        assert all(r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)
