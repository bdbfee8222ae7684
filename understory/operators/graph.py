"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.checkpoint import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge but the roots: root is the smallest node reachable.

    Each round hangs neighbours under the smallest neighbour, first from every node to its larger ones, then to its
    smaller ones; the edges keep their components and end as stars. Minima are aggregated before they are joined
    back, so a node with very many edges is no single task's group. Loops and repeated edges do not matter.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    state = None
    while (seen := _state(now)) != state:
        state = seen
        if not seen[0]:
            break
        now = cut(_smaller(_larger(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    # sums of halves of a hash: neither overflows
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(0x7FFFFFFF)), F.sum(F.shiftrightunsigned(h, 33))).first())


def _larger(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
