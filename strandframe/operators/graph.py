"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators._folders import let_go, shared_folder


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge to another one: root is the smallest node reachable.

    Alternates large-star and small-star rounds, each a few group-bys with map-side partial minima, until the edges
    are a forest of stars (no node has two parents, no parent has one); the number of rounds grows with the logarithm
    of a component's size. Every round is checkpointed to the shared folder; one row at most reaches the driver. Null
    ends are dropped.
    """
    shared_folder(edges.sparkSession)
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = one.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    for _ in range(max_rounds):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").head(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join below meets exchanges on both sides and a hub can be split
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours, and the node itself, are tied to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = small.where("u <> v").distinct().checkpoint()
        del both, low, large, least, tied, small, ends
        let_go(edges.sparkSession)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
