"""Conversation repair against a search over all cheapest edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from postlens.llm import conversation_repair as cr
from postlens.llm.conversation_repair import repair, repaired_turns

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else x
        fault = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def follow(said, initial):
    return initial in {"": "su", "s": "u", "u": "a", "a": "u"}[said]


def cheapest(marks):
    """(cost, audit) of rows (initial, must go, truncated), over all edits."""

    @lru_cache(maxsize=None)
    def best(k, said, inserted):
        found = []
        if inserted < 3:
            for r in "ua":
                if follow(said, r):
                    c, a = best(k, r, inserted + 1)
                    found.append((c + 2, "I" + a))
        if k == len(marks):
            found += [(0, "")] if said in ("", "a") else []
        else:
            initial, gone, cut = marks[k]
            c, a = best(k + 1, said, 0)
            found.append((c + 3, "D" + a))
            if not gone and initial and follow(said, initial):
                c, a = best(k + 1, initial, 0)
                found.append((c + cut, "K" + a))
            for r in "ua":
                if not gone and follow(said, r):
                    c, a = best(k + 1, r, 0)
                    found.append((c + 2 + cut, "R" + a))
        return min(found, default=(10**9, ""))

    for k in range(len(marks), 0, -1):  # from the end, so that the recursion stays flat
        for said in ("", "s", "u", "a"):
            best(k, said, 0)
    return best(0, "", 0)


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in harm([r for r in rows if r[0] == conv])]
        mine.sort(key=lambda r: (r[0] is not None, r[0], r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, marks, counts = set(), [], [0, 0, 0]
        for _, role, text in mine:
            stripped = text.strip(" \t\n\v\f\r")
            fault = 0 if not stripped else 1 if (role, text) in seen else 2 if stripped[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marks.append((role[:1] if role[:1] in "sua" else "", fault in (0, 1), int(fault == 2)))
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(tuple(marks))
        done, at = [], iter(mine)
        for edit in audit:
            _, role, text = next(at) if edit != "I" else (0, "", "")
            said = done[-1][0][0] if done else ""
            if edit in "IR":
                role = "assistant" if said == "u" else "user"
            if edit != "D":
                done.append((role, text))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def talk(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, segment int, place string, audit string"
    return lambda rows: spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema)


def chatter(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Well.", "Yes!  ", "no end", "", " \t", None, "Why?\n", "é。", f"Number {turn}."])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    return rows


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert rows_of(repair(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_random_conversations(talk):
    rows = chatter(1, 300, 9)
    assert rows_of(repair(talk(rows))) == brute(rows)


def test_one_conversation_over_many_segments_and_tasks(talk, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT_BITS", 2)
    rows = [(None, t, r, x) for _, t, r, x in chatter(2, 60, 5)] + chatter(3, 20, 30)
    assert rows_of(repair(talk(rows))) == brute(rows)


def test_all_rows_equal(talk):
    rows = [(None, None, "user", "Hello.")] * 300 + [(5, None, None, None)] * 40
    assert rows_of(repair(talk(rows))) == brute(rows)


def test_no_rows_and_no_rows_left(talk):
    assert repair(talk([])).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert rows_of(repair(talk([(gone, 1, "user", "Hi.")]))) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]


def test_a_long_text_and_turns_out(talk):
    rows = [(900, 1, "system", "Be brief."), (900, 2, "user", "long " * 200_000 + "."), (900, 3, "assistant", "Done.")]
    kept = harm(rows)
    assert rows_of(repair(talk(rows))) == brute(rows)
    turns = sorted(tuple(r) for r in repaired_turns(talk(rows)).collect())
    assert [t[1] for t in turns] == list(range(len(turns))) and len(turns) >= len(kept) - 1


def test_ranked_paths_are_the_least_of_all():
    rng = random.Random(9)
    for size in (1, 2, 5, 40):
        batch = ["".join(chr(65 + rng.randrange(16)) for _ in range(size)) for _ in range(50)]
        for places, cells, sizes in cr._padded(batch):
            left = np.tile([0, 4, 2, 0], (len(places), 1))
            audits, _ = cr.least_paths(cells, sizes, left, np.ones(len(places), bool))
            for k, found in zip(places, audits):
                codes = [ord(c) - 65 for c in batch[k]]
                marks = tuple(("sua"[c % 4] if c % 4 < 3 else "", c // 4 >= 2, int(c // 4 == 1)) for c in codes)
                assert found[0] == cheapest(marks)[1]
