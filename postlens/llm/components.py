"""Connected components of a large edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Scratch

MOST_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes with an edge.

    ``edges`` has columns a and b, in any order and with repeats; an edge with a null end is
    none. An empty table gives no rows. In a large-star step all
    larger neighbours of a node are tied to its smallest one, in a small-star step all
    smaller ones; both only need the smallest neighbour, a partial aggregate, and a join.
    The number of edges never grows by more than the nodes.
    """
    tied = scratch.table(
        edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}-0",
    )
    before = None
    for k in range(1, MOST_ROUNDS + 1):
        both = tied.select("u", "v").union(tied.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = scratch.table(
            both.filter("v > u").join(scratch.table(least, f"{name}-{k}-large-least"), "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            f"{name}-{k}-large",
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(scratch.table(least, f"{name}-{k}-small-least"), "u")
        tied = scratch.table(
            small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v"))).distinct(),
            f"{name}-{k}",
        )
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k}-large-least", f"{name}-{k}-large", f"{name}-{k}-small-least")
        now = tied.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = tied.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(tied.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
