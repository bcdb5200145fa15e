"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Each round at least halves long paths; a graph that needs more is an error, not a wrong answer.
MAX_ROUNDS = 60


#: Parts that a node's links are split into at most, before they meet under the node itself.
SALTS = 32


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with m, the smallest v of their u.  A node's links are
    split by a hash of v, and only the parts meet, so that a node with very many
    links is no single task's work."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("least"))
    least = parts.groupBy("u").agg(F.min("least").alias("m"))
    return salted.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, component): of each node in ``links`` (a, b), the smallest node
    that it reaches.

    Alternates large-star and small-star steps until all components are stars.
    Null nodes have no links; repeated links and links of a node with itself
    add nothing; an empty table gives an empty result.
    """
    edges = C.checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(MAX_ROUNDS):
        if _are_stars(edges):
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v")
        least = _with_least(large.distinct())
        # The smallest neighbour itself stays linked to u, the others are linked to it.
        small = least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = C.checkpointed(small.filter("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each component is one smallest node and the rest linked to it:
    each larger node once, and none of them the smaller node of a link."""
    if edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").head(1):
        return False
    return not edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi").head(1)
