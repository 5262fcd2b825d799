"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise


def _least(pairs: DataFrame, node: str, other: str) -> DataFrame:
    # the second grouping key is 0 for each row; it keeps the result from being partitioned by node alone,
    # so that the join that follows exchanges both sides and a hub's rows can be split
    return pairs.withColumn("z", F.shiftright(F.col(node), 63)).groupBy(node, "z").agg(F.min(other).alias("least")).drop("z")


def _stars(e: DataFrame) -> bool:
    """Whether each node has one edge only, to a node that has none: then every component is one star."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge to another.

    Node identifiers are integers of 0 or more. Each round is two aggregations and two joins over at most as
    many edges as there were; rounds grow with the logarithm of the number of nodes. State is
    written to the shared folder each round.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = materialise(e, "edges", light=True)
    for _ in range(rounds):
        if _stars(e):
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both, "u", "v").select("u", F.least("u", "least").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least(large, "u", "v").withColumnRenamed("least", "m")
        near = large.join(low, "u")
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, materialise(small, "edges", light=True)
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
