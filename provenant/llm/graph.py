"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable

#: The least neighbours of a graph of up to so many edges are broadcast (16 bytes a node, 4 MB at most); larger ones are joined by shuffle.
FEW_EDGES = 1 << 17

def _stars(edges: DataFrame, few: bool) -> DataFrame:
    """A large star (larger neighbours are linked to the least one), then a small star (smaller ones are) on edges (u, v), u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
    large = edges.join(F.broadcast(around) if few else around, "v").select("u", F.least("m", "v").alias("v"))
    if not few:  # it is read twice
        large = large.distinct()
    below = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(F.broadcast(below) if few else below, "u")
    return joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of edges (u, v), u > v, and of nodes that keep them from being stars around least nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first())


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """``node, root`` for every node of an edge table ``a, b``; the root is the least node."""
    current = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most):
        number, loose = _state(current)
        if not loose:
            break
        current = durable(_stars(current, number <= FEW_EDGES))
    else:
        raise RuntimeError("the components did not settle")
    roots = current.select("v").distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
