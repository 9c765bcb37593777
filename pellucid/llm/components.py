"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm.common import materialize


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``(u, v)`` has either one edge to a root or only edges from others."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = ends.unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up + root > 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every end of ``edges``; ``component`` is the least node reachable.

    Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond",
    2014) shrink the graph to stars in about log(n) rounds. Neighbour lists are never gathered: each
    step is a minimum per node, summed up before the shuffle, and a join. Edges with a null end are
    left out; loops and repeats do not matter; an empty table gives an empty result.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the smaller neighbours of a node, and the node itself, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct())
        if _are_stars(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    # each node is a leaf or a root now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())
