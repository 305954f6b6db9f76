"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become integers, so that counts, sums and the scatter of all vectors are exact
integer sums: they do not depend on how the table is split. Spark adds up one small matrix
a partition; what reaches the driver grows with the dimension alone. There the centred
scatter is factored with diagonal pivoting, V = L L', and the columns of the triangular
factor L are rotated against each other until they are orthogonal. Then V = (L J)(L J)': the
squared norms of the rotated columns are the eigenvalues of V, the normalised columns its
eigenvectors. V itself is never rotated, so small eigenvalues keep their relative accuracy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import arrow_schema, only

SCALE = 64
SHIFT = 1_000_000
MOST_COMPONENTS = 32
#: Entries beyond this have no exact integer form in a double; they count as non-finite.
LARGEST = float(1 << 52)
#: Products of centred entries below this are exact in a double.
_EXACT = 1 << 26
#: Rows handled at once in a task.
ROWS = 4096


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, pivots): lower-trapezoidal ``factor`` with matrix[pivots][:, pivots] =
    factor @ factor.T, as many columns as the numerical rank. The largest diagonal entry
    that is left is eliminated next; of equal ones the first. A dimension is spent when
    what is left of its own variance is rounding."""
    rest, n = matrix.copy(), len(matrix)
    pivots, factor = np.arange(n), np.zeros((n, n))
    least = 8 * n * np.finfo(float).eps * matrix.diagonal()
    for k in range(n):
        open_ = rest.diagonal()[k:] > least[pivots[k:]]
        if not open_.any():
            return factor[:, :k], pivots
        p = k + int(np.where(open_, rest.diagonal()[k:], -1.0).argmax())
        for swapped in (rest, rest.T, factor):
            swapped[[k, p]] = swapped[[p, k]]
        pivots[[k, p]] = pivots[[p, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, pivots


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs (a round-robin)."""
    seats, out = list(range(n + n % 2)), []
    half = len(seats) // 2
    for _ in range(len(seats) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:half], seats[: half - 1 : -1]) if max(a, b) < n]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` times rotations, with columns orthogonal to double precision, longest first."""
    turned = factor.copy()
    rounds, bound = _rounds(turned.shape[1]), 4 * np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for i, j in rounds:
            if not len(i):
                continue
            a, b = turned[:, i], turned[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            off = np.abs(ab) / np.sqrt(aa * bb)
            worst = max(worst, float(off.max()))
            act = off > bound
            safe = np.where(act, ab, 1.0)
            zeta = (bb - aa) / (2 * safe)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(act, t, 0.0)
            c = 1 / np.hypot(1.0, t)
            turned[:, i], turned[:, j] = c * (a - t * b), c * (b + t * a)
        if worst <= bound:
            break
    return turned[:, np.argsort(-(turned * turned).sum(0), kind="stable")]


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of a positive semidefinite matrix, falling, rank only."""
    factor, pivots = pivoted_cholesky(matrix)
    turned = np.zeros_like(factor)
    turned[pivots] = jacobi_columns(factor)
    norms = np.sqrt((turned * turned).sum(0))
    return norms * norms, turned / norms


def _whole(column: str) -> Column:
    """Whether a vector has entries, all of them finite."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) <= LARGEST)
    vector = F.col(column)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fits), F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer entries) of runs of rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            run = batch.slice(start, ROWS)
            flat = run.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield run.column("vec_id"), np.floor(SCALE * flat).astype(np.int64) + SHIFT


def exact_product(z: np.ndarray) -> np.ndarray:
    """z.T @ z of integers, exact, as Python integers."""
    most = int(np.abs(z).max(initial=0))
    if most >= _EXACT:
        wide = z.astype(object)
        return wide.T @ wide
    rows, total = max(1, (1 << 53) // max(1, most * most)), np.zeros((z.shape[1],) * 2, object)
    for start in range(0, len(z), rows):
        part = z[start : start + rows].astype(float)
        total += (part.T @ part).astype(np.int64)
    return total


def _summed(vectors: DataFrame, dim: int, cells: Callable[[np.ndarray], tuple]) -> dict[tuple[int, int], int]:
    """Sums over all vectors of ``cells``: exact integers at (i, j), one partial a task."""
    schema = "i int, j int, v decimal(38,0)"
    out = arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        total = None
        for _, x in _blocks(batches, dim):
            part = cells(x)
            total = part if total is None else tuple(a + b for a, b in zip(total, part))
        if total is not None:
            rows = [(i, j, Decimal(int(v))) for i, line in enumerate(total) for j, v in enumerate(np.atleast_1d(line))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    sums = vectors.mapInArrow(partial, schema).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): int(r["v"]) for r in sums.collect()}


def whiten(embeddings: DataFrame, most: int = MOST_COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Entries c become x = floor(64 c) + 1000000. All vectors that are kept are the fit list; n
    is their number, the covariance has divisor n. ``deviation`` is the exact sum of
    (n x - S)^2, null where it does not fit a long. ``explained`` is the eigenvalue's share of
    the trace, ``identity_error`` the largest entry of the whitened vectors' covariance minus
    the identity, measured over all rows.

    Null vectors, vectors with a null or non-finite entry (or one beyond 2^52 / 64) and empty
    vectors are dropped. The commonest length is the dimension (of equally common ones the
    largest); vectors of other lengths are dropped too. Directions without variance have no
    component, so equal vectors alone, or one vector, give no rows, as does an empty table.
    Null and repeated vec_ids are rows like any other. Other columns are not read.
    """
    spark = embeddings.sparkSession
    id_type = dict(embeddings.dtypes)["vec_id"]
    schema = (
        f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, "
        "identity_error double"
    )
    whole = only(embeddings, "vec_id", "embedding").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector")
    ).filter(_whole("vector"))
    lengths = whole.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return spark.createDataFrame([], schema)
    dim, n = top["d"], top["n"]
    vectors = whole.filter(F.size("vector") == dim)

    sums = _summed(vectors, dim, lambda x: (x.astype(object).sum(0),))
    total = [sums[0, j] for j in range(dim)]
    middle = np.array([s // n for s in total])

    # About the whole part of the mean, so that the numbers stay small; the exact scatter
    # about the mean itself follows from it.
    products = _summed(vectors, dim, lambda x: tuple(exact_product(x - middle)))
    left = [s - n * int(m) for s, m in zip(total, middle)]
    scatter = np.array([
        [float(Fraction(n * products[i, j] - left[i] * left[j], n * n)) for j in range(dim)] for i in range(dim)
    ])
    values, vectors_of = eigen(scatter)
    if not len(values):
        return spark.createDataFrame([], schema)
    share = (values / scatter.trace())[:most]
    turn = vectors_of[:, :most] / np.sqrt(values[:most])
    fraction = np.array([x / n for x in left])
    width = turn.shape[1]

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - middle) - fraction) @ turn

    def covariance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((width, width)), np.zeros(width)
        for _, x in _blocks(batches, dim):
            w = project(x)
            total, first = total + w.T @ w, first + w.sum(0)
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel()), pa.array(first[i]), pa.array(first[j])],
            names=["i", "j", "v", "a", "b"],
        )

    summed = (
        vectors.mapInArrow(covariance, "i int, j int, v double, a double, b double").groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in "vab"])
    )
    off = F.abs(F.col("v") / n - F.col("a") * F.col("b") / (n * n) - (F.col("i") == F.col("j")).cast("int"))
    error = summed.agg(F.max(off)).first()[0]

    out, left_sum = arrow_schema(schema), np.array([int(x) for x in left], object)
    #: n z - left stays below this if all of its squares may be summed in 64 bits.
    small = int((((1 << 63) - 1) // dim) ** 0.5) - 1

    def deviations(x: np.ndarray) -> list[int | None]:
        z = x - middle
        if n * int(np.abs(z).max(initial=0)) + max(abs(v) for v in left) < small:
            exact = n * z - np.array(left, np.int64)
            return (exact * exact).sum(1).tolist()
        exact = n * z.astype(object) - left_sum
        return [v if v < 1 << 63 else None for v in (int(v) for v in (exact * exact).sum(1))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dim):
            k = len(x)
            at = pa.array(np.repeat(np.arange(k), width))
            columns = [
                ids.take(at), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), k)),
                pa.array(np.full(k * width, n, np.int64)), pa.array(deviations(x), pa.int64()).take(at),
                pa.array(project(x).ravel()), pa.array(np.tile(share, k)), pa.array(np.full(k * width, error)),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return vectors.mapInArrow(rows, schema)
