"""Similar pairs of dense vectors: exact, by metric cells.

The angle between unit vectors is a metric. A few rows serve as pivots; every vector lives in
the cell of its nearest pivot. A vector can have a partner in the cell of pivot q only if q
is no farther than the cell's radius and the wanted angle, and no farther than twice that
angle beyond its own pivot: it visits those cells, and no others. Within a cell, rows are cut
into rings about the pivot, and rings into blocks of bounded size, so that a cell that holds
most of the rows is many blocks. Two blocks meet in a tile unless their rings differ by more
than the wanted angle (triangle inequality); a tile is one matrix product.

No pair is lost whatever the pivots are: they decide the cost alone. Where the vectors
have no structure, the bounds rule out little and the cost is that of all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.session import checkpoint

PIVOTS = 16
#: Rows among which the pivots are chosen.
PIVOT_SAMPLE = 512
#: Rows of a block, about. A row travels once for every block it meets.
BLOCK = 4096
#: Rows placed, or multiplied with a block, at once.
STRIP = 512
#: Slack of the bounds, in radians, for rounding.
_SLACK = 1e-7


def usable(vector: str = "vector") -> Column:
    """Whether a vector has a direction."""
    return F.coalesce(_norm(F.col(vector)) > 0, F.lit(False))


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """The vector over its length."""
    return F.transform(vector, lambda x: x.cast("double") / _norm(vector))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _angles(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ others.T, -1.0, 1.0))


def choose_pivots(rows: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Up to ``count`` unit vectors of a bounded number of rows, each far from the others."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("unit").collect()
    sample = np.array([r["unit"] for r in some])
    chosen = [0]
    nearest = _angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _angles(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _placed(rows: DataFrame, pivots: np.ndarray, reach: float, radii: dict[int, float] | None) -> DataFrame:
    """(id, place, unit, cell, angle): each row in its own cell, or, given the cells' radii,
    in every cell with a possible partner."""
    schema = f"id {dict(rows.dtypes)['id']}, place bigint, unit array<double>, cell int, angle double"
    bounds = None if radii is None else np.array([radii.get(k, -math.inf) for k in range(len(pivots))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STRIP):
                run = batch.slice(start, STRIP)
                angles = _angles(_matrix(run.column("unit")), pivots)
                if bounds is None:
                    row, cell = np.arange(len(angles)), angles.argmin(1)
                else:
                    near = angles.min(1, keepdims=True)
                    row, cell = np.nonzero((angles <= bounds + reach + _SLACK) & (angles - near <= 2 * reach + _SLACK))
                at = pa.array(row)
                columns = [run.column(c).take(at) for c in ("id", "place", "unit")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(cell.astype(np.int32)), pa.array(angles[row, cell])],
                    names=["id", "place", "unit", "cell", "angle"],
                )

    return rows.select("id", "place", "unit").mapInArrow(place, schema)


def _blocked(rows: DataFrame, reach: float, name: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their block, and (cell, block, from, to): the blocks' rings."""
    ringed = rows.withColumn("ring", F.floor(F.col("angle") / (reach / 2)).cast("int"))
    sizes = ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("held"))
    parts = F.ceil(F.col("held") / block).cast("int")
    # One row per cell and ring, not per vector.
    cut = ringed.join(F.broadcast(sizes.select("cell", "ring", parts.alias("parts"))), ["cell", "ring"]).withColumn(
        name, F.concat_ws(".", "ring", F.pmod(F.xxhash64("id"), "parts"))
    )
    rings = cut.groupBy("cell", name).agg(F.min("angle").alias(f"{name}_from"), F.max("angle").alias(f"{name}_to"))
    return cut.select("id", "place", "unit", "cell", name), rings


def near_pairs(left: DataFrame, right: DataFrame, least: float, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """``(id, other, cosine)``: rows of ``left`` and rows of ``right`` before them (by
    ``place``) whose cosine is at least ``least``, each pair once.

    Both sides have ``id, place, unit`` with vectors of one length. The result is exact.
    """
    schema = f"id {dict(left.dtypes)['id']}, other {dict(right.dtypes)['id']}, cosine double"
    if left.isEmpty() or right.isEmpty():
        return left.sparkSession.createDataFrame([], schema)
    heads = choose_pivots(right, pivots)
    reach = math.acos(max(-1.0, min(1.0, least)))
    homes = checkpoint(_placed(left, heads, reach, None))
    radii = {r["cell"]: r["radius"] for r in homes.groupBy("cell").agg(F.max("angle").alias("radius")).collect()}
    guests = checkpoint(_placed(right, heads, reach, radii))
    home, home_rings = _blocked(homes, reach, "home", block)
    guest, guest_rings = _blocked(guests, reach, "guest", block)
    apart = F.greatest(F.col("home_from") - F.col("guest_to"), F.col("guest_from") - F.col("home_to"))
    tiles = checkpoint(
        home_rings.join(guest_rings, "cell").filter(apart <= reach + _SLACK).select("cell", "home", "guest")
    )
    key = ["cell", "home", "guest"]

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        a, b = _matrix(one.column("unit").combine_chunks()), _matrix(two.column("unit").combine_chunks())
        if not len(a) or not len(b):
            return out.empty_table()
        ids, others = one.column("id").combine_chunks(), two.column("id").combine_chunks()
        place, before = one.column("place").to_numpy(), two.column("place").to_numpy()
        found = []
        for start in range(0, len(a), STRIP):
            scores = a[start : start + STRIP] @ b.T
            i, j = np.nonzero((scores >= least) & (before[None, :] < place[start : start + STRIP, None]))
            found.append(pa.table([ids.take(pa.array(i + start)), others.take(pa.array(j)), pa.array(scores[i, j])], schema=out))
        return pa.concat_tables(found)

    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(left.sparkSession.createDataFrame([], schema).schema)
    rows = lambda side, name: side.join(tiles, ["cell", name]).select(*key, "id", "place", "unit").groupBy(*key)
    return rows(home, "home").cogroup(rows(guest, "guest")).applyInArrow(meet, schema)


def first_of_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id)``: the nodes that the sequential rule keeps, which takes the nodes in order and
    keeps one unless an earlier kept node is its neighbour.

    ``edges(id, other)`` lead from a node to an earlier one. Each round keeps every node
    without an undecided earlier neighbour and drops the neighbours of those kept, so the
    number of rounds is the longest chain of such decisions, not the number of nodes kept.
    """
    kept: list[DataFrame] = []
    edges = checkpoint(edges.select("id", "other"))
    while not edges.isEmpty():
        found = checkpoint(nodes.join(edges.select("id").distinct(), "id", "left_anti"))
        kept.append(found)
        dropped = checkpoint(
            edges.join(found.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()
        )
        decided = found.unionByName(dropped)
        nodes = checkpoint(nodes.join(decided, "id", "left_anti"))
        edges = checkpoint(
            edges.join(dropped, "id", "left_anti")
            .join(decided.select(F.col("id").alias("other")), "other", "left_anti").select("id", "other")
        )
    out = nodes
    for part in kept:
        out = out.unionByName(part)
    return out
