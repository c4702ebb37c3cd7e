"""Connected components of an edge table by alternating large-star and small-star steps.

Each round rewires edges to the smallest neighbour with partial aggregation before the shuffle;
rounds are few (logarithmic in a component's diameter) and each is written to the shared folder,
so neither lineage nor the driver grows with the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(smallest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v) links of bigint nodes to (node, root): root is the component's smallest node.

    Only nodes with a link to another node are returned, the root itself included.  Null ends and
    loops are dropped; repeated edges count once; an empty table gives an empty one.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    edges = stored(edges.dropna().where("u != v").select(u.alias("u"), v.alias("v")).distinct(), label)
    before = _print(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)), label)
        after = _print(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _print(edges: DataFrame) -> tuple:
    """Count and a hash of the edge set: equal twice in a row means that nothing moved."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
