"""MinHash classes against brute force over all pairs."""

import numpy as np
import pytest
from test_dedup import near, rows_of

from postlens.llm import minhash
from postlens.llm.minhash import BANDS, HASHES, band_names, minhash_duplicates, signatures

NEAR = ("doc_id", "n_shingles", "component_id")


def test_documents(docs, texts):
    got = minhash_duplicates(docs)
    assert rows_of(got, *NEAR) == near(texts, 3, 85)
    assert rows_of(got.filter("kept"), "doc_id") == sorted(((i,) for i, _, c in near(texts, 3, 85) if i == c), key=str)


def test_odd_rows(table, odd_rows):
    assert rows_of(minhash_duplicates(table(odd_rows)), *NEAR) == near(odd_rows, 3, 85)


def test_without_rows(table):
    assert minhash_duplicates(table([])).count() == 0
    assert rows_of(minhash_duplicates(table([(1, None), (2, " ")])), *NEAR) == [(1, 0, 1), (2, 0, 2)]


def many(copies=120):
    """Chains, texts on both sides of the bound and a group of copies that all differ."""
    words, rows, n = [f"w{i}" for i in range(400)], [], 0
    for shift in range(0, 200, 5):  # a chain whose ends share little
        rows.append((n := n + 1, " ".join(words[shift : shift + 100])))
    for cut in range(1, 40):
        rows.append((n := n + 1, " ".join(f"v{i}" for i in range(140 - cut))))
    for k in range(copies):
        rows.append((n := n + 1, " ".join(f"x{k}.{i}" if (i * 7 + k * 13) % 197 < k % 5 else f"u{i}" for i in range(180))))
    return rows


def test_bound_chains_and_a_large_group(table):
    assert rows_of(minhash_duplicates(table(many())), *NEAR) == near(many(), 3, 85)


def test_buckets_cut_into_many_tiles(table, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    assert rows_of(minhash_duplicates(table(many(60))), *NEAR) == near(many(60), 3, 85)


def test_a_lower_bound_is_an_error(table):
    with pytest.raises(ValueError):
        minhash_duplicates(table([]), least=(80, 100))


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.85):
        common, n = int(2000 * share), (2000 - int(2000 * share)) // 2
        pool = rng.integers(0, 1 << 64, common + 2 * n, dtype=np.uint64)
        one, two = pool[: common + n], np.concatenate([pool[:common], pool[common + n :]])
        minima = signatures(np.concatenate([one, two]), np.array([len(one), len(two)]))
        assert abs((minima[0] == minima[1]).mean() - share) < 0.12
        assert band_names(minima).shape == (2, BANDS) and minima.shape == (2, HASHES)
    same = signatures(np.concatenate([one, one[::-1]]), np.array([len(one)] * 2))
    assert (band_names(same)[0] == band_names(same)[1]).all()
