"""Exact, substring and near-duplicate removal against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from postlens.llm.exact_dedup import content_keys, drop_copies, exact_dedup
from postlens.llm.jaccard_join import drop_near_copies, near_duplicates
from postlens.llm.substring_dedup import remove_repeats

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(i):
    return -1 if i is None else i


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    out = []
    for t, ids in groups.items():
        keep, sha = max(ids, key=key), hashlib.sha256(t.encode()).hexdigest()
        left = 1
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left == 1, sha))
            left -= i == keep
    return sorted(out, key=str)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("block", [3, 64, 16384])
def test_exact_on_odd_rows(table, odd_rows, block):
    rows = [r for r in odd_rows if block > 3 or len(r[1] or "") < 1000]
    assert rows_of(exact_dedup(table(rows), block_bytes=block), *EXACT) == exact(rows)


def test_exact_on_documents(docs, texts):
    assert rows_of(exact_dedup(docs, block_bytes=512), *EXACT) == exact(texts)


def test_exact_without_rows(table):
    assert exact_dedup(table([])).count() == 0


def test_exact_takes_other_keys_when_two_blocks_share_one(table):
    tried = []

    def weak(block, attempt):
        tried.append(attempt)
        return [F.lit(0)] if attempt == 0 else content_keys(block, attempt)

    rows = [(1, "a"), (2, "b"), (3, "a")]
    assert rows_of(exact_dedup(table(rows), keys=weak), *EXACT) == exact(rows)
    assert 1 in tried


def test_drop_copies_keeps_columns_and_one_row_of_each_text(table, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 1000]
    left = drop_copies(table(rows))
    assert left.columns == table(rows).columns
    assert rows_of(left, "doc_id") == sorted(((i,) for i, _, _, kept, _ in exact(rows) if kept), key=str)


def repeats(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            i2 = 1 << 62 if i is None else i
            first[k] = min(first.get(k, i2), i2)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < (1 << 62 if i is None else i):
                gone[a : a + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


REPEATS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_repeats_on_documents(docs, texts):
    assert rows_of(remove_repeats(docs, with_text=False), *REPEATS) == repeats(texts, 50)


def test_repeats_on_odd_rows(table, odd_rows):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [*odd_rows, (20, f"a {passage} b"), (21, f"{passage}\n{passage} c"), (None, passage), (22, "p " * 120), (23, "p " * 49)]
    assert rows_of(remove_repeats(table(rows)), *REPEATS) == repeats(rows, 50)


def test_short_windows_and_kept_text(table):
    rows = [(1, "a b c d e f"), (2, "x b c d e y"), (3, "b c d")]
    got = remove_repeats(table(rows), window=3, gram=2)
    assert rows_of(got, *REPEATS) == repeats(rows, 3)
    assert {r["doc_id"]: r["kept_text"] for r in got.collect()} == {1: "a b c d e f", 2: "x y", 3: ""}


def test_repeats_without_rows(table):
    assert remove_repeats(table([])).count() == 0


def near(rows, width=5, least=75):
    sets, root = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[a : a + width]) for a in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for j, s in enumerate(sets):
        common = Counter(k for t in s for k in held[t])
        for t in s:
            held[t].append(j)
        for k, n in common.items():
            if 100 * n >= least * (len(s) + len(sets[k]) - n):
                root[find(j)] = find(k)
    least = {}
    for j, (i, _) in enumerate(rows):
        if i is not None:
            least[find(j)] = min(least.get(find(j), i), i)
    return sorted(((i, len(sets[j]), least.get(find(j))) for j, (i, _) in enumerate(rows)), key=str)


NEAR = ("doc_id", "n_shingles", "component_id")


def test_near_on_documents(docs, texts):
    assert rows_of(near_duplicates(docs), *NEAR) == near(texts)


def test_near_on_odd_rows(table, odd_rows):
    assert rows_of(near_duplicates(table(odd_rows)), *NEAR) == near(odd_rows)


def test_near_without_rows(table):
    assert near_duplicates(table([])).count() == 0


def test_near_at_the_bound_and_in_chains(table):
    words = [f"w{i}" for i in range(200)]
    rows, n = [], 0
    for shift in range(0, 120, 10):  # a chain whose ends share little
        rows.append((n := n + 1, " ".join(words[shift : shift + 80])))
    for cut in range(1, 40):  # prefixes of one text on both sides of the bound
        rows.append((n := n + 1, " ".join(f"v{i}" for i in range(100 - cut))))
    for k in range(60):  # copies of one text with a few words changed
        rows.append((n := n + 1, " ".join(f"x{k}.{i}" if (i * 7 + k * 13) % 97 < k % 7 else f"u{i}" for i in range(120))))
    assert rows_of(near_duplicates(table(rows)), *NEAR) == near(rows)


def test_drop_near_copies_keeps_one_of_each_class(table):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(3, base), (2, base + " more"), (2, base + " more"), (5, "something else entirely in five"), (6, None)]
    left = drop_near_copies(table(rows))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 5, 6]
