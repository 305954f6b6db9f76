"""Whitening against a dense eigenvalue solver and exact integers."""

import math
import random

import numpy as np
import pytest

from postlens.llm.whitening import eigen, exact_product, jacobi_columns, pivoted_cholesky, whiten


def brute(rows, most=32):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by integers and eigh."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, total = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[float(c - s // n) - (s - n * (s // n)) / n for c, s in zip(v, total)] for v in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for (i, _), v, z in zip(kept, x, y):
        dev = sum((n * c - s) ** 2 for c, s in zip(v, total))
        for k in range(min(most, len(e))):
            if e[k] > 1e-9 * e[0]:
                out[i, k + 1] = (n, dev, abs(z @ u[:, k]) / math.sqrt(e[k]), e[k] / e.sum())
    return out


def check(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    for r in got:
        n, dev, w, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, dev)
        assert abs(r["whitened"]) == pytest.approx(w, rel=1e-6, abs=1e-6)
        assert r["explained"] == pytest.approx(share, rel=1e-6)
        assert r["identity_error"] < 1e-8


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, n int, vector string")

    return make


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in df.collect()]
    check(whiten(df).collect(), brute(rows))


def test_signs_agree_and_splits_do_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    one = {(r["vec_id"], r["component"]): r["whitened"] for r in whiten(df.repartition(1)).collect()}
    many = {(r["vec_id"], r["component"]): r["whitened"] for r in whiten(df.repartition(13)).collect()}
    assert one.keys() == many.keys()
    assert max(abs(one[k] - many[k]) for k in one) < 1e-9


def test_odd_rows(vectors):
    random.seed(5)
    good = [(i, [random.gauss(0, 1 + j) for j in range(5)]) for i in range(40)]
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in good]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, float("nan"), 2.0, 3.0, 4.0]),
           (104, [1.0, float("inf"), 2.0, 3.0, 4.0]), (105, [1.0, 2.0]), (106, [3e38] * 5)]
    check(whiten(vectors(good + odd)).collect(), brute(good))


def test_fewer_directions_than_dimensions(vectors):
    random.seed(6)
    rows = [(i, [a := float(random.randint(-9, 9)), 2 * a, b := float(random.randint(-9, 9)), a - b, 7.0]) for i in range(30)]
    got = whiten(vectors(rows)).collect()
    assert {r["component"] for r in got} == {1, 2}
    check(got, brute(rows))


def test_nothing_to_whiten(vectors):
    assert whiten(vectors([])).collect() == []
    assert whiten(vectors([(1, [1.0, 2.0])])).collect() == []
    assert whiten(vectors([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_null_and_repeated_ids(vectors):
    rows = [(None, [1.0, 2.0]), (None, [3.0, 1.0]), (7, [0.0, 5.0]), (7, [0.0, 5.0])]
    got = whiten(vectors(rows)).collect()
    assert len(got) == 8 and sum(r["vec_id"] is None for r in got) == 4


def test_deviation_that_fits_no_long_is_null(spark):
    rows = [(i, [1e12 * i, float(i % 3)]) for i in range(6)]
    got = whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    assert len(got) == 12 and all(r["deviation"] is None for r in got if r["vec_id"] in (0, 5))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33])
def test_factor_and_rotations(n):
    rng = np.random.default_rng(n)
    root = rng.normal(size=(n, n)) * np.logspace(0, -4, n)
    matrix = root @ root.T
    factor, pivots = pivoted_cholesky(matrix)
    assert np.allclose(np.triu(factor, 1), 0) and np.allclose(factor @ factor.T, matrix[pivots][:, pivots], atol=1e-12)
    turned = jacobi_columns(factor)
    gram = turned.T @ turned
    scale = np.sqrt(gram.diagonal())
    assert np.abs(gram / np.outer(scale, scale) - np.eye(factor.shape[1])).max() < 1e-12
    values, u = eigen(matrix)
    assert np.allclose((u * values) @ u.T, matrix, atol=1e-12)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(matrix))[::-1][: len(values)], rtol=1e-6)


def test_products_of_integers_are_exact():
    rng = np.random.default_rng(1)
    for size in (300, 1 << 25, 1 << 40):
        z = rng.integers(-size, size, (50, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j])) for j in range(4)] for i in range(4)]
        assert exact_product(z).tolist() == want
