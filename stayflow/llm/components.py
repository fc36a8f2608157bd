"""Connected components of a graph given as a table of edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.sources.store import release, written


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long), any direction, repeats and loops allowed -> (node, root), root the smallest node reachable.

    Each round takes a large-star step, in which the larger neighbours of a node move to the smallest node that it
    knows, then a small-star step, in which the smaller ones do. The rounds grow with the logarithm of the number of
    nodes. A node's smallest neighbour is aggregated before the shuffle and only then joined to its edges, so that no
    task holds all neighbours of a node. Each round's edges are written to the shared folder and
    deleted after the next round. Nodes that only have loops are left out. Nulls are no nodes.
    """
    e = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, old = written(large, "edges"), e
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        small = large.join(least, "u").select(ends.alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        release(old, large)
        before, mark = mark, _mark(e)
        if mark == before:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _mark(e: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
