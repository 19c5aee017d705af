"""Connected components of an edge table, by joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: columns a and b of one ordered type, in any order, repeats and loops allowed. Returns (node, component), component being the
    least node that node reaches; nodes without edges to others are left out.

    Each round hangs every node on the least neighbour of its neighbourhood (large star, then small star), which keeps
    reachability and ends in stars round the least nodes after a number of rounds logarithmic in the longest path. Both
    halves are minima by key, which Spark combines before it shuffles, and joins on the key, whose large partitions adaptive
    execution splits; no neighbourhood is gathered in one array. Each round is written to the shared folder.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
